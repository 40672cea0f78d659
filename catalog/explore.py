"""Exploration queries."""

from pyspark.sql import functions as F

from catalog.inputs import documents, examples, long, raw
from catalog.registry import query
from catalog.sql import (
    TOOL_NAMES, examples_sql, long_sql, pieces, quoted, raw_sql,
)
from turnflow.operators import explore, turns
from turnflow.operators.token_tables import mark_truncated, with_token_count
from turnflow.operators.splitting import stratified_split
from turnflow.sources.traces import table_profile as profile_of

NULLS = {
    "primary id": "id", "company task id": "id", "assistant model name": "assistant_model", "task": "task",
    "company name": "company_name", "annual revenue": "annual_revenue", "number of employees": "number_of_employees",
    "total payroll": "total_payroll", "number of vehicles": "number_of_vehicles",
    "building construction": "building_construction", "state": "state", "company description": "company_description",
    "lob": "lob", "reference answer": "reference_answer", "correct": "correct",
    "trace": "CASE WHEN has_trace THEN 1 END",
}
EACH_NULL = " UNION ALL ".join(
    f"SELECT {quoted(name)} AS column_name, count(*) FILTER (WHERE ({value}) IS NULL) AS nulls, "
    f"round(count(*) FILTER (WHERE ({value}) IS NULL) * 100.0 / count(*), 2) AS percent FROM raw" for name, value in NULLS.items()
)

# Per document: the split that the stratified split by language gives (seed 42, 75 / 12.5 / 12.5).
SPLIT_DOCUMENTS = """
strata AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1),
sized AS (SELECT *, sum(n) OVER () AS total, floor(0.75 * sum(n) OVER ())::BIGINT AS wanted FROM strata),
dealt AS (SELECT *, (n * wanted) // total AS whole, (n * wanted) % total AS rest FROM sized),
first AS (
  SELECT stratum, n, total, wanted,
         whole + (row_number() OVER (ORDER BY rest DESC, stratum) <= wanted - sum(whole) OVER ())::BIGINT AS train_places
  FROM dealt
),
sized2 AS (SELECT *, n - train_places AS n2, total - wanted AS total2, floor(0.5 * (total - wanted))::BIGINT AS wanted2 FROM first),
dealt2 AS (SELECT *, (n2 * wanted2) // total2 AS whole2, (n2 * wanted2) % total2 AS rest2 FROM sized2),
quotas AS (
  SELECT stratum, train_places,
         whole2 + (row_number() OVER (ORDER BY rest2 DESC, stratum) <= wanted2 - sum(whole2) OVER ())::BIGINT AS validation_places
  FROM dealt2
),
split_documents AS (
  SELECT d.*, CASE WHEN place <= train_places THEN 'train'
                   WHEN place <= train_places + validation_places THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents) d
  JOIN quotas q ON q.stratum = d.lang
)"""
COUNTED = f""",
{SPLIT_DOCUMENTS},
counted AS (
  SELECT e.id, s.split, e.task, len({pieces('e.text')}) AS token_count, e.num_turns + 1 AS num_messages
  FROM examples e JOIN split_documents s ON s.doc_id = e.id
)"""


def split_documents(spark, folder):
    return stratified_split(documents(spark, folder), "doc_id", by="lang")


def split_examples(spark, folder):
    """Training examples with the split of their document and their token count.

    Tokens are counted and messages dropped before the join, which then moves a few numbers per row.
    """
    split = split_documents(spark, folder).select(F.col("doc_id").alias("original_index"), "split")
    counted = with_token_count(examples(spark, folder)).withColumn("num_messages", F.size("messages"))
    return counted.select("original_index", "task", "num_turns", "num_messages", "token_count").join(split, "original_index")


@query(raw_sql("SELECT count(*) AS num_examples FROM raw"))
def table_profile(spark, folder):
    return profile_of(raw(spark, folder)).select("num_examples")


@query(raw_sql(EACH_NULL))
def null_profile(spark, folder):
    return explore.null_profile(raw(spark, folder)).withColumn("nulls", F.col("nulls").cast("long"))


LENGTHS = """SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, min(n)::BIGINT AS min,
  max(n)::BIGINT AS max, round(stddev_pop(n), 6) AS std FROM"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(raw_sql(f"{LENGTHS} (SELECT CASE WHEN has_trace THEN n_messages ELSE 0 END AS n FROM raw)"))
def trace_length_stats(spark, folder):
    return rounded(explore.trace_length_stats(raw(spark, folder)), "mean", "median", "std")


@query(long_sql(f"{LENGTHS} (SELECT count(*) AS n FROM raw_messages GROUP BY id)"))
def conversation_length_stats(spark, folder):
    sizes = long(spark, folder).groupBy("conv_id").agg(F.count("*").alias("n"))
    return rounded(explore.length_stats(sizes, "n"), "mean", "median", "std")


@query(raw_sql("""SELECT company_name, annual_revenue, number_of_employees, total_payroll, number_of_vehicles,
  building_construction, state, company_description, lob FROM raw"""))
def company_table(spark, folder):
    return explore.company_table(raw(spark, folder))


@query(raw_sql("""SELECT coalesce(task, 'unknown') AS task, count(*) AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM raw), 6) AS percent FROM raw GROUP BY 1"""))
def task_distribution(spark, folder):
    return rounded(explore.task_distribution(raw(spark, folder)), "percent")


@query(raw_sql("""SELECT correct, count(*) AS n,
  round(count(*) * 100.0 / (SELECT count(correct) FROM raw), 6) AS percent FROM raw WHERE correct IS NOT NULL GROUP BY 1"""))
def correctness_distribution(spark, folder):
    return rounded(explore.correctness_distribution(raw(spark, folder)), "percent")


USAGE = f"SELECT tool, count(*) AS calls FROM (SELECT unnest({TOOL_NAMES}) AS tool FROM raw_messages) GROUP BY 1"


@query(raw_sql(USAGE))
def tool_usage(spark, folder):
    return explore.tool_usage(raw(spark, folder))


@query(long_sql(USAGE))
def tool_usage_of_turns(spark, folder):
    return turns.tool_usage(long(spark, folder))


def histogram_sql(rows: str, value: str, bins: int, by: str = "0") -> str:
    """All bins of every group; `by` is a constant for a single one."""
    return f"""SELECT g, bin, round(low + bin * width, 6) AS low, round(low + (bin + 1) * width, 6) AS high, count(v) AS n
  FROM (SELECT {by} AS g, min({value})::DOUBLE AS low, (max({value}) - min({value})) / {bins}::DOUBLE AS width FROM {rows} GROUP BY 1)
  CROSS JOIN (SELECT unnest(range({bins}))::INTEGER AS bin)
  LEFT JOIN (SELECT {by} AS k, {value} AS v FROM {rows}) ON k = g AND least(floor((v - low) / width)::INTEGER, {bins - 1}) = bin
  GROUP BY 1, 2, 3, 4"""


def binned(found, by="0"):
    return rounded(found.select(F.expr(by).alias("g"), "bin", "low", "high", "n"), "low", "high")


@query(examples_sql(histogram_sql("examples", "num_turns", 20)))
def turn_histogram(spark, folder):
    return binned(explore.histogram(examples(spark, folder), "num_turns", 20))


@query(raw_sql(histogram_sql("(SELECT CASE WHEN has_trace THEN n_messages ELSE 0 END AS n FROM raw)", "n", 20)))
def trace_length_histogram(spark, folder):
    lengths = raw(spark, folder).select(F.coalesce(F.when(F.col("trace").isNotNull(), F.size("trace")), F.lit(0)).alias("n"))
    return binned(explore.histogram(lengths, "n", 20))


@query("SELECT * FROM (" + histogram_sql("documents", "n_chars", 30, "lang") + ")")
def length_histogram(spark, folder):
    return binned(explore.histogram(documents(spark, folder), "n_chars", 30, "lang"), "lang")


@query(examples_sql(histogram_sql("counted", "token_count", 30, "split"), COUNTED))
def token_histogram(spark, folder):
    return binned(explore.histogram(split_examples(spark, folder), "token_count", 30, "split"), "split")


def box_sql(rows: str, value: str, by: str) -> str:
    return f"""fences AS (
  SELECT {by} AS k, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3 FROM {rows} GROUP BY 1
), fenced AS (
  SELECT t.*, f.*, {value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM {rows} t JOIN fences f ON t.{by} = f.k
)"""


BOX = """SELECT {by}, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  min(CASE WHEN inside THEN {value} END)::DOUBLE AS whisker_low, max(CASE WHEN inside THEN {value} END)::DOUBLE AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS outliers FROM fenced GROUP BY 1"""


@query("WITH " + box_sql("documents", "n_chars", "lang") + BOX.format(by="lang", value="n_chars"))
def length_box_stats(spark, folder):
    return rounded(explore.box_stats(documents(spark, folder), "n_chars", "lang"), "q1", "median", "q3")


@query("WITH " + box_sql("events", "value", "event_type") + BOX.format(by="event_type", value="value"))
def value_box_stats(spark, folder):
    """A measure with as many distinct values as rows."""
    return rounded(explore.box_stats(spark.read.parquet(f"{folder}/events.parquet"), "value", "event_type"), "q1", "median", "q3")


@query("WITH " + box_sql("documents", "n_chars", "lang") + "SELECT doc_id, lang, n_chars FROM fenced WHERE NOT inside")
def length_outliers(spark, folder):
    return explore.box_outliers(documents(spark, folder).select("doc_id", "lang", "n_chars"), "n_chars", "lang")


@query(examples_sql(BOX.format(by="split", value="token_count"), COUNTED + ", " + box_sql("counted", "token_count", "split")))
def token_box_stats(spark, folder):
    return rounded(explore.box_stats(split_examples(spark, folder), "token_count", "split"), "q1", "median", "q3")


@query("""SELECT lang, n_chars, doc_id,
  round(row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) * 100.0 / count(*) OVER (PARTITION BY lang), 6) AS share
  FROM documents""")
def cumulative_share(spark, folder):
    return rounded(explore.cumulative_share(documents(spark, folder), "n_chars", "lang", "doc_id"), "share")


@query(examples_sql("""SELECT split, count(*) AS total, count(*) FILTER (WHERE token_count > 1024) AS truncated,
  round(count(*) FILTER (WHERE token_count > 1024) * 100.0 / count(*), 6) AS percent FROM counted GROUP BY 1""", COUNTED))
def truncation_impact(spark, folder):
    return rounded(explore.truncation_impact(mark_truncated(split_examples(spark, folder), 1024)), "percent")


@query(examples_sql("""SELECT split, rank, id AS original_index, token_count, num_messages, coalesce(task, 'N/A') AS task,
  greatest(token_count - 1024, 0) AS tokens_over_limit
  FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY token_count DESC, id) AS rank FROM counted) WHERE rank <= 3""", COUNTED))
def longest_examples(spark, folder):
    found = explore.longest_examples(split_examples(spark, folder), 1024)
    return found.withColumns({c: F.col(c).cast("long") for c in ("rank", "token_count", "num_messages", "tokens_over_limit")})


@query(examples_sql("""SELECT m.id AS original_index, e.task, e.num_turns, m.pos AS position, upper(m.role) AS role,
  m.content FROM messages m JOIN examples e ON e.id = m.id"""))
def show_example(spark, folder):
    shown = explore.show_example(examples(spark, folder))
    return shown.withColumns({c: F.col(c).cast("long") for c in ("num_turns", "position")})
