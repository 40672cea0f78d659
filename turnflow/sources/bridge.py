"""Toolkit inputs derived from the shared test tables.

`documents` give raw examples in nested form (one line of text per message), and
`conversations` give messages in long form.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.constants import IGNORED_LABEL

TOOLS = [
    "list_tables",
    "get_table_schema",
    "get_table_descriptions",
    "get_table_data_dictionary",
    "read_query",
    "get_underwriting_guidelines",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tool_call(number: Column) -> Column:
    tools = F.array(*[F.lit(name) for name in TOOLS])
    return F.concat(F.lit("[{'name': '"), F.get(tools, number % len(TOOLS)), F.lit("'}]"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Company columns per customer, under the names of the raw corpus."""
    revenue = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice")).cast("long").alias("revenue")
    )
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    return (
        customer.join(revenue, F.col("o_custkey") == key, "left")
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select(
            key,
            F.col("c_mktsegment").alias("segment"),
            F.col("c_name").alias("company name"),
            F.col("revenue").alias("annual revenue"),
            ((key * 37) % 5000).alias("number of employees"),
            F.round(F.col("c_acctbal") * 10).cast("long").alias("total payroll"),
            (key % 7).alias("number of vehicles"),
            F.when(key % 11 != 0, "Masonry").alias("building construction"),
            F.col("n_name").alias("state"),
            F.when(key % 5 != 0, F.concat("c_mktsegment", F.lit(" company"))).alias("company description"),
            F.lower("c_mktsegment").alias("lob"),
        )
    )


def correct_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    return labels.select("doc_id", (F.col("quality") == 1).alias("correct"))


def _trace(text: Column, doc: Column) -> Column:
    """A message per line; blank and null messages are added between them."""

    def messages(line: Column, i: Column) -> Column:
        kind = F.when(i % 11 == 10, -1).otherwise((doc + i) % 5)
        types = F.when(kind == 0, "underwriter").when(kind.isin(1, 3), "internal assistant").when(
            kind == 2, "tool").when(kind == 4, "user-facing assistant")
        role = F.when(kind == -1, "system").when(kind == 0, "user").otherwise("assistant")
        calls = F.when(kind == 1, _tool_call(doc + i)).otherwise("")
        made, blank = (
            F.struct(role.alias("role"), content.alias("content"), types.alias("type"), calls.alias("tool_calls"))
            for content in (line, F.lit(""))
        )
        before = F.when((kind == 1) & (doc % 2 == 0), F.array(blank)).otherwise(F.array_remove(F.array(blank), blank))
        return F.concat(before, F.when(i % 13 == 12, F.array(made, F.lit(None))).otherwise(F.array(made)))

    return F.flatten(F.transform(F.split(text, "\n"), messages))


def raw_examples(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` as raw examples: one per document, its lines as the trace, and some without a trace."""
    doc = F.col("doc_id")
    documents = table(spark, folder, "documents")
    without = documents.where(doc % 97 == 96).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", -1 - doc)
    return (
        documents.unionByName(without)
        .join(correct_labels(spark, folder), "doc_id", "left")
        .join(profiles(spark, folder).drop("segment"), doc == F.col("c_custkey"), "left")
        .select(
            doc.alias("primary id"),
            doc.alias("company task id"),
            F.col("source").alias("assistant model name"),
            F.when(doc % 50 != 49, F.col("lang")).alias("task"),
            "company name", "annual revenue", "number of employees", "total payroll", "number of vehicles",
            "building construction", "state", "company description", "lob",
            F.concat(F.lit("answer in "), "lang").alias("reference answer"),
            "correct",
            _trace(F.col("text"), doc).alias("trace"),
        )
    )


def bridge_turns(spark: SparkSession, folder: str) -> DataFrame:
    """`conversations` as raw messages, assistant text cut at its first line break."""
    raw = table(spark, folder, "conversations")
    role, text, turn = F.col("role"), F.col("text"), F.col("turn")
    assistant = role == "assistant"
    cut = F.instr(text, "\n")

    def part(number: int, author: str | Column, kind: str | Column, content: Column, calls: Column) -> Column:
        return F.struct(
            F.lit(number).alias("part"),
            (F.lit(author) if isinstance(author, str) else author).alias("role"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
            content.alias("content"),
            calls.alias("tool_calls"),
        )

    none = F.lit("")
    calling = F.when(
        assistant & (turn % 3 == 1),
        part(0, "assistant", "internal assistant", none, _tool_call(F.col("conv_id"))),
    )
    thinking = F.when(
        assistant & (cut > 0),
        part(1, "assistant", "internal assistant", F.substring(text, F.lit(1), cut - 1), none),
    )
    saying = part(
        2,
        F.when(role == "user", "user").otherwise("assistant"),
        F.when(role == "user", "underwriter").when(role == "system", "tool").otherwise("user-facing assistant"),
        F.when(assistant & (cut > 0), F.substring(text, cut + 1, F.length(text))).otherwise(text),
        none,
    )
    parts = F.array_compact(F.array(calling, thinking, saying))
    return raw.select("conv_id", "turn", F.explode(parts).alias("p")).select("conv_id", "turn", "p.*")


def judge_samples(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as sampled judge answers."""
    value = F.col("value")
    score = F.least(F.floor(value / 20), F.lit(9)).cast("string")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("example_id"),
        (F.col("user_id") % 6).cast("string").alias("task"),
        F.col("event_type").alias("criterion_key"),
        F.col("event_id").alias("sample"),
        F.when(F.col("event_id") % 10 == 0, "no score here").otherwise(F.concat(F.lit("ok SCORE: "), score)).alias("content"),
        (value / 1000).alias("cost_usd"),
    )


def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as a metric log with one run."""
    return table(spark, folder, "events").select(
        F.lit("r0").alias("run_id"),
        F.col("event_type").alias("tag"),
        F.col("event_id").alias("step"),
        "value",
    )


def logits(spark: SparkSession, folder: str) -> DataFrame:
    """`embeddings` as logits and labels by sequence and position."""
    vec = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        F.floor(vec / 50).alias("seq"),
        (vec % 50).alias("pos"),
        F.col("embedding").alias("logits"),
        F.when(vec % 4 == 0, IGNORED_LABEL).otherwise(F.col("label")).alias("label"),
    )
