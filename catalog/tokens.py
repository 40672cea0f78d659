"""Template, token, label, batch and split queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.explore import COUNTED, SPLIT_DOCUMENTS, rounded, split_documents, split_examples
from catalog.inputs import documents, examples, merged_long, prompts_long
from catalog.registry import query
from catalog.sql import LONG, EXAMPLES, examples_sql, long_examples_sql, piece_id, pieces, rendered
from turnflow.constants import IGNORED_LABEL, PAD_ID, TRAINING_LENGTH, VOCAB_SIZE
from turnflow.functions import chat, tokens
from turnflow.operators import batches, splitting, token_tables, turns

ID = "original_index"
ROW = "e.id AS original_index"


def digest(column: str):
    """Array of numbers as one comparable text."""
    return F.md5(F.array_join(F.col(column).cast("array<string>"), ","))


def digest_sql(numbers: str) -> str:
    return f"md5(array_to_string({numbers}, ','))"


def padded_sql(numbers: str, length: int | str, value: int) -> str:
    return f"list_concat({numbers}, list_transform(range(greatest({length} - len({numbers}), 0)), lambda z: {value}))"


def ids_sql(text: str, length: int) -> str:
    return f"list_transform(({pieces(text)})[1:{length}], lambda p: {piece_id('p')})"


@query(examples_sql(f"SELECT {ROW}, md5(text) AS text, length(text)::BIGINT AS chars FROM examples e"))
def render_chat(spark, folder):
    text = examples(spark, folder).select(ID, chat.render_chat(F.col("messages")).alias("t"))
    return text.select(ID, F.md5("t").alias("text"), F.length("t").cast("long").alias("chars"))


@query(examples_sql(f"SELECT {ROW}, md5(text || '<|im_start|>assistant' || chr(10)) AS prompt FROM examples e"))
def render_prompt(spark, folder):
    return examples(spark, folder).select(ID, F.md5(chat.render_prompt(F.col("messages"))).alias("prompt"))


@query(long_examples_sql(f"""SELECT m.id AS conv_id, coalesce(g.turn, -1) AS turn, {rendered('m.role', 'm.content')} AS segment
  FROM messages m LEFT JOIN merged g ON g.id = m.id AND g.pos = m.pos"""))
def rendered_messages_of_turns(spark, folder):
    """Messages of the usable conversations with their system message, without the target."""
    split = turns.split_target(merged_long(spark, folder))
    usable = split.filter(F.col("is_target") & (F.col("offset") == 0)).select("conv_id")
    prompts = prompts_long(spark, folder).join(usable, "conv_id", "left_semi")
    rendered = turns.rendered_messages(turns.with_system_messages(split.filter(~F.col("is_target")), prompts))
    return turns.whole_messages(rendered.select(
        "conv_id", "turn", "part", "role", "offset", F.col("segment").alias("content"), F.lit(0).alias("merged_turns"), F.lit(0).alias("chars"),
    )).select("conv_id", "turn", F.col("content").alias("segment"))


def long_counts(spark, folder) -> DataFrame:
    return turns.token_counts(turns.split_target(merged_long(spark, folder)), prompts_long(spark, folder))


@query(examples_sql(f"""SELECT {ROW}, {digest_sql(ids_sql("e.text", 10 ** 9))} AS ids, len({pieces('e.text')}) AS n FROM examples e"""))
def tokenize(spark, folder):
    ids = examples(spark, folder).select(ID, tokens.tokenize(chat.render_chat(F.col("messages"))).alias("t"))
    return ids.select(ID, digest("t").alias("ids"), F.size("t").cast("long").alias("n"))


@query(examples_sql(f"""SELECT original_index, num_turns, {digest_sql(padded_sql('ids', 1024, PAD_ID))} AS input_ids,
  {digest_sql(padded_sql('ids', 1024, PAD_ID))} AS labels, least(len(ids), 1024) AS masked_in
  FROM (SELECT {ROW}, num_turns, {ids_sql('e.text', 1024)} AS ids FROM examples e)"""))
def tokenize_dataset(spark, folder):
    rows = token_tables.tokenize_dataset(examples(spark, folder))
    return rows.select(
        ID, F.col("num_turns").cast("long").alias("num_turns"), digest("input_ids").alias("input_ids"),
        digest("labels").alias("labels"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda total, x: total + x).alias("masked_in"),
    )


@query(examples_sql(f"SELECT {ROW}, len({pieces('e.text')}) AS token_count FROM examples e"))
def token_count(spark, folder):
    counted = token_tables.with_token_count(examples(spark, folder))
    return counted.select(ID, F.col("token_count").cast("long").alias("token_count"))


@query(long_examples_sql(f"SELECT id AS conv_id, len({pieces('text')}) AS token_count FROM examples"))
def token_count_of_turns(spark, folder):
    return long_counts(spark, folder)


STATISTICS = """count(*) AS n, round(avg(token_count), 6) AS mean, min(token_count)::BIGINT AS min,
  max(token_count)::BIGINT AS max, round(stddev_pop(token_count), 6) AS std,
  round(quantile_cont(token_count, 0.25), 6) AS p25, round(quantile_cont(token_count, 0.5), 6) AS p50,
  round(quantile_cont(token_count, 0.75), 6) AS p75, round(quantile_cont(token_count, 0.9), 6) AS p90,
  round(quantile_cont(token_count, 0.95), 6) AS p95, round(quantile_cont(token_count, 0.99), 6) AS p99,
  round(quantile_cont(token_count, 0.5), 6) AS median"""
MOMENTS = ["mean", "std", "p25", "p50", "p75", "p90", "p95", "p99", "median"]


@query(examples_sql(f"SELECT {STATISTICS} FROM counted", COUNTED))
def token_statistics(spark, folder):
    return rounded(token_tables.token_statistics(token_tables.with_token_count(examples(spark, folder))), *MOMENTS)


LONG_COUNTS = f"""WITH {LONG}, {EXAMPLES.replace('{task}', 'segment')},
counted AS (SELECT id, len({pieces('text')}) AS token_count FROM examples)"""


@query(f"{LONG_COUNTS} SELECT {STATISTICS} FROM counted")
def token_statistics_of_turns(spark, folder):
    return rounded(token_tables.token_statistics(long_counts(spark, folder)), *MOMENTS)


@query(examples_sql("""SELECT id AS original_index, token_count, token_count > 1024 AS will_truncate,
  greatest(token_count - 1024, 0) AS tokens_over_limit FROM counted""", COUNTED))
def mark_truncated(spark, folder):
    marked = token_tables.mark_truncated(token_tables.with_token_count(examples(spark, folder)), 1024)
    return marked.select(ID, "will_truncate", *[F.col(c).cast("long").alias(c) for c in ("token_count", "tokens_over_limit")])


TRUNCATION = """count(*) AS total_examples, count(*) FILTER (WHERE token_count > {limit}) AS truncated_count,
  round(count(*) FILTER (WHERE token_count > {limit}) * 100.0 / count(*), 6) AS truncated_percentage,
  max(greatest(token_count - {limit}, 0))::BIGINT AS max_tokens_over,
  round(coalesce(avg(CASE WHEN token_count > {limit} THEN token_count - {limit} END), 0.0), 6) AS avg_tokens_over"""


@query(examples_sql(f"SELECT {TRUNCATION.format(limit=1024)} FROM counted", COUNTED))
def truncation_stats(spark, folder):
    _, stats = token_tables.truncation_report(examples(spark, folder), 1024)
    return rounded(stats, "truncated_percentage", "avg_tokens_over")


@query(examples_sql("""SELECT id AS original_index, token_count - 1024 AS tokens_over_limit FROM counted
  WHERE token_count > 1024""", COUNTED))
def truncated_rows(spark, folder):
    marked, _ = token_tables.truncation_report(examples(spark, folder), 1024)
    return token_tables.truncated_rows(marked).withColumn("tokens_over_limit", F.col("tokens_over_limit").cast("long"))


@query(examples_sql("""SELECT floor(quantile_cont(token_count, 0.95))::BIGINT AS at_95,
  floor(avg(token_count) + 2 * stddev_pop(token_count))::BIGINT AS at_80 FROM counted""", COUNTED))
def recommended_max_length(spark, folder):
    counted = token_tables.with_token_count(examples(spark, folder))
    stored = token_tables.recommended_max_length(counted, 95.5).withColumnRenamed("recommended_max_length", "at_95")
    other = token_tables.recommended_max_length(counted, 80)
    return stored.withColumn("at_80", other.scalar())


LIMITED = f"""{COUNTED},
recommended AS (SELECT floor(quantile_cont(token_count, 0.95))::BIGINT AS r FROM counted WHERE split = 'train')"""


@query(examples_sql(f"""SELECT split, {STATISTICS}, {TRUNCATION.format(limit='r')}, any_value(r) AS recommended_max_length
  FROM counted, recommended GROUP BY split""", LIMITED))
def analyze_splits(spark, folder):
    per_split, _ = token_tables.analyze_splits(split_examples(spark, folder))
    return rounded(per_split, *MOMENTS, "truncated_percentage", "avg_tokens_over")


@query(examples_sql("""SELECT any_value(r) AS recommended_max_length, count(*) AS total_examples,
  count(*) FILTER (WHERE token_count > r) AS truncated_count, round(count(*) FILTER (WHERE token_count > r) * 100.0 / count(*), 6) AS truncated_percentage
  FROM counted, recommended""", LIMITED))
def overall_truncation(spark, folder):
    _, overall = token_tables.analyze_splits(split_examples(spark, folder))
    return rounded(overall, "truncated_percentage")


SFT = f""",
texts AS (SELECT id, num_turns, text || '<|im_start|>assistant' || chr(10) AS prompt, target_response FROM examples),
sized AS (
  SELECT id, num_turns, len({pieces('prompt')}) AS prompt_length,
         {pieces("(prompt || target_response || '<|im_end|>' || chr(10))")} AS every FROM texts
),
cut AS (
  SELECT id, num_turns, prompt_length, every[1:{{length}}] AS kept FROM sized
),
sft AS (
  SELECT id, num_turns, list_transform(kept, lambda p: {piece_id('p')}) AS ids,
         list_transform(kept, lambda p, i: CASE WHEN i > prompt_length THEN {piece_id('p')} ELSE {IGNORED_LABEL} END) AS labels
  FROM cut
)"""


def sft_sql(select: str, length: int) -> str:
    return examples_sql(select, SFT.replace("{length}", str(length)))


PREPARED = f"""SELECT id AS original_index, num_turns, {digest_sql(padded_sql('ids', '{length}', PAD_ID))} AS input_ids,
  {digest_sql(padded_sql('labels', '{length}', IGNORED_LABEL))} AS labels, len(ids) AS masked_in FROM sft"""


@query(sft_sql(f"""SELECT id AS original_index, num_turns, {TRAINING_LENGTH}::BIGINT AS width, len(ids) AS masked_in,
  {digest_sql('ids')} AS ids, {digest_sql(f"list_filter(labels, lambda x: x <> {IGNORED_LABEL})")} AS trained,
  greatest({TRAINING_LENGTH} - len(ids), 0) AS padding FROM sft""", TRAINING_LENGTH))
def prepare_sft(spark, folder):
    prepared = token_tables.prepare_sft(examples(spark, folder))
    masked_in = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda total, x: total + x)
    measured = prepared.withColumn("masked_in", masked_in).withColumns({
        "ids": F.slice("input_ids", F.lit(1), F.col("masked_in").cast("int")),
        "trained": F.filter("labels", lambda x: x != IGNORED_LABEL),
        "padding": F.size(F.filter("input_ids", lambda x: x == PAD_ID)).cast("long"),
    })
    return measured.select(
        ID, F.col("num_turns").cast("long").alias("num_turns"), F.size("labels").cast("long").alias("width"), "masked_in",
        digest("ids").alias("ids"), digest("trained").alias("trained"), "padding",
    )


def digested(prepared: DataFrame) -> DataFrame:
    return prepared.select(
        ID, F.col("num_turns").cast("long").alias("num_turns"), digest("input_ids").alias("input_ids"),
        digest("labels").alias("labels"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda total, x: total + x).alias("masked_in"),
    )


@query(sft_sql(PREPARED.replace("{length}", "512"), 512))
def sft_labels(spark, folder):
    return digested(token_tables.prepare_sft(examples(spark, folder), max_length=512))


@query(sft_sql("SELECT id AS original_index FROM sft WHERE len(list_filter(labels, lambda x: x <> -100)) = 0", 512))
def untrainable_examples(spark, folder):
    prepared = token_tables.prepare_sft(examples(spark, folder), max_length=512)
    return token_tables.untrainable_examples(prepared).select(ID)


@query(examples_sql(f"""SELECT original_index, num_turns, {digest_sql(padded_sql('ids', 1024, PAD_ID))} AS input_ids,
  len({padded_sql('ids', 1024, PAD_ID)}) AS width
  FROM (SELECT {ROW}, num_turns, {ids_sql('e.text', 1024)} AS ids FROM examples e)"""))
def model_inputs(spark, folder):
    inputs = token_tables.model_inputs(token_tables.tokenize_dataset(examples(spark, folder)), metadata=True)
    return inputs.select(ID, F.col("num_turns").cast("long").alias("num_turns"), digest("input_ids").alias("input_ids"),
                         F.size("attention_mask").cast("long").alias("width"))


@query(examples_sql(f"""SELECT {ROW}, {digest_sql(ids_sql("(e.text || '<|im_start|>assistant' || chr(10))", 1024))} AS ids FROM examples e"""))
def truncate_prompt(spark, folder):
    prompts = token_tables.prompt_ids(examples(spark, folder), max_length=1024)
    return prompts.select(ID, digest("prompt_ids").alias("ids"))


def batches_sql(order: str) -> str:
    return f"""SELECT doc_id, split, (nth - 1) // 4 AS batch, (nth - 1) % 4 AS slot FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY {order}) AS nth FROM split_documents)"""


@query(f"WITH {SPLIT_DOCUMENTS} {batches_sql('md5(7 || chr(58) || doc_id), doc_id')}")
def assign_batches(spark, folder):
    rows = split_documents(spark, folder).select("doc_id", "split")
    return batches.assign_batches(rows, "doc_id", seed=7, by=("split",))


@query(f"WITH {SPLIT_DOCUMENTS} {batches_sql('doc_id')}")
def assign_batches_in_order(spark, folder):
    rows = split_documents(spark, folder).select("doc_id", "split")
    return batches.assign_batches(rows, "doc_id", shuffle=False, by=("split",))


def batched_tokens(spark, folder) -> DataFrame:
    ids = token_tables.tokenize_dataset(examples(spark, folder), padding=False)
    return batches.assign_batches(ids, ID, shuffle=False)


COLLATED = f""",
tokenized AS (SELECT id, {ids_sql('text', 1024)} AS ids FROM examples),
batched AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 4 AS batch FROM tokenized),
measured AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM batched)"""


@query(examples_sql(f"""SELECT id AS original_index, batch, width, {digest_sql(padded_sql('ids', 'width', PAD_ID))} AS input_ids,
  {digest_sql(padded_sql('ids', 'width', IGNORED_LABEL))} AS labels, len(ids) AS masked_in FROM measured""", COLLATED))
def collate(spark, folder):
    rows = batches.collate(batched_tokens(spark, folder))
    return rows.select(
        ID, "batch", F.size("input_ids").cast("long").alias("width"), digest("input_ids").alias("input_ids"),
        digest("labels").alias("labels"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda total, x: total + x).alias("masked_in"),
    )


def draw_sql(at: int) -> str:
    return f"('0x' || substr(md5('42:' || id || ':' || (i - 1)), {at}, 8))::BIGINT"


CHOSEN = f"({draw_sql(1)} < {int(0.15 * 2**32)} AND p <> {PAD_ID})"
MASKED = f"""{COLLATED},
masked AS (
  SELECT *, list_transform(ids, lambda p, i: CASE WHEN NOT {CHOSEN} THEN p WHEN {draw_sql(9)} % 10 < 8 THEN {VOCAB_SIZE + 1}
                                                  WHEN {draw_sql(9)} % 10 = 8 THEN {draw_sql(17)} % {VOCAB_SIZE} ELSE p END) AS shown,
         list_transform(ids, lambda p, i: CASE WHEN {CHOSEN} THEN p ELSE {IGNORED_LABEL} END) AS kept
  FROM measured
)"""


@query(examples_sql(f"""SELECT id AS original_index, batch, width, {digest_sql(padded_sql('shown', 'width', PAD_ID))} AS input_ids,
  {digest_sql(padded_sql('kept', 'width', IGNORED_LABEL))} AS labels FROM masked""", MASKED))
def collate_masked(spark, folder):
    rows = batches.collate(batched_tokens(spark, folder), mlm=True)
    return rows.select(ID, "batch", F.size("input_ids").cast("long").alias("width"), digest("input_ids").alias("input_ids"),
                       digest("labels").alias("labels"))


@query(f"""WITH {SPLIT_DOCUMENTS} SELECT split, (row_number() OVER w - 1) // 4 AS batch, (row_number() OVER w - 1) % 4 AS slot
  FROM split_documents WINDOW w AS (PARTITION BY split ORDER BY doc_id % 100)""")
def assign_batches_repeated_ids(spark, folder):
    rows = split_documents(spark, folder).select((F.col("doc_id") % 100).alias("doc_id"), "split")
    return batches.assign_batches(rows, "doc_id", shuffle=False, by=("split",)).select("split", "batch", "slot")


@query(f"WITH {SPLIT_DOCUMENTS} SELECT doc_id, lang, split FROM split_documents")
def stratified_split(spark, folder):
    return split_documents(spark, folder).select("doc_id", "lang", "split")


@query("""SELECT doc_id, CASE WHEN place <= t THEN 'train' WHEN place <= t + v THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place,
         floor(0.75 * count(*) OVER ())::BIGINT AS t, floor(0.5 * (count(*) OVER () - floor(0.75 * count(*) OVER ())))::BIGINT AS v
  FROM documents)""")
def random_split(spark, folder):
    return splitting.random_split(documents(spark, folder), "doc_id").select("doc_id", "split")


LEAKAGE = """SELECT '{kind}' AS kind, count(*) AS shared_keys, coalesce(sum(n), 0)::BIGINT AS rows_affected
  FROM (SELECT {key} AS k, count(*) AS n FROM split_documents GROUP BY 1 HAVING count(DISTINCT split) > 1)"""


@query(f"WITH {SPLIT_DOCUMENTS} {LEAKAGE.format(kind='id', key='doc_id')} UNION ALL {LEAKAGE.format(kind='text', key='text')}")
def split_leakage(spark, folder):
    return splitting.split_leakage(split_documents(spark, folder), "doc_id", "text")


def spread_sql(value: str, name: str) -> str:
    return f"""round(avg({value}), 6) AS {name}_mean, round(quantile_cont({value}, 0.5), 6) AS {name}_median,
  min({value})::BIGINT AS {name}_min, max({value})::BIGINT AS {name}_max, round(stddev_pop({value}), 6) AS {name}_std"""


@query(examples_sql(f"""SELECT split, count(*) AS num_examples, {spread_sql('num_messages - 1', 'turns')},
  {spread_sql('length(text)', 'text')} FROM counted JOIN examples e ON e.id = counted.id GROUP BY 1""", COUNTED))
def split_statistics(spark, folder):
    split = split_documents(spark, folder).select(F.col("doc_id").alias(ID), "split")
    # texts are rendered before the join, which moves their lengths only
    texts = examples(spark, folder).select(ID, "num_turns", chat.render_chat(F.col("messages")).alias("formatted_text"))
    rows = texts.join(split, ID)
    stats = splitting.split_statistics(rows)
    return rounded(stats, *[c for c in stats.columns if c.endswith(("_mean", "_median", "_std"))])


@query(examples_sql("""SELECT split, task, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 6) AS percent FROM counted GROUP BY 1, 2""", COUNTED))
def split_tasks(spark, folder):
    return rounded(splitting.split_tasks(split_examples(spark, folder)), "percent")


@query(examples_sql("""SELECT split, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM counted), 6) AS percent,
  round(avg(num_messages - 1), 6) AS turns_mean, round(stddev_pop(num_messages - 1), 6) AS turns_std
  FROM counted GROUP BY 1""", COUNTED))
def split_summary(spark, folder):
    return rounded(splitting.split_summary(split_examples(spark, folder)), "percent", "turns_mean", "turns_std")
