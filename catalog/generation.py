"""Generation and judge queries. Stand-ins answer in place of models; the SQL repeats their rules."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.explore import rounded, split_documents, COUNTED
from catalog.inputs import examples
from catalog.registry import query, ship_code
from catalog.sql import examples_sql, pieces, prompt, quoted
from turnflow.constants import (
    CRITERIA, JUDGE_ANSWER, JUDGE_CLOSING, JUDGE_HISTORY, JUDGE_OPENING, JUDGE_PROFILE, JUDGE_REFERENCE, JUDGE_STEPS,
    SYSTEM_PREAMBLE, TRAINING_LENGTH,
)
from turnflow.functions.text import parse_score as score_of
from turnflow.functions.text import strip_think
from turnflow.operators import generation, judging
from turnflow.plans.shared import shared_folder
from turnflow.schemas import CRITERION
from turnflow.sources.bridge import judge_samples

ID = "original_index"


def load_echo():
    """A generator that repeats the last user turn and fails on every seventh message count."""

    def answer(batch):
        if any(len(messages) % 7 == 0 for messages in batch):
            raise ValueError("cannot answer")
        said = [[m["content"] for m in messages if m["role"] == "user"] for messages in batch]
        return [turns[-1] if turns else "" for turns in said]

    return answer


ECHO = f""",
echoed AS (
  SELECT m.id, count(*) % 7 = 0 AS fails, coalesce(arg_max(m.content, m.pos) FILTER (m.role = 'user'), '') AS said
  FROM messages m GROUP BY 1
),
generated AS (
  SELECT e.id, coalesce(e.task, 'unknown') AS task, e.target_response, CASE WHEN NOT fails THEN said END AS generated_response,
         CASE WHEN fails THEN 'cannot answer' END AS error,
         CASE WHEN NOT fails THEN least(len({pieces("(e.text || '<|im_start|>assistant' || chr(10))")}), {TRAINING_LENGTH}) END AS input_tokens,
         CASE WHEN NOT fails THEN len({pieces('said')}) END AS output_tokens
  FROM examples e JOIN echoed g ON g.id = e.id
)"""
GENERATED = examples_sql("""SELECT id AS original_index, task, target_response, generated_response, error, input_tokens,
  output_tokens FROM generated""", ECHO)


def shown(df: DataFrame) -> DataFrame:
    counts = {c: F.col(c).cast("long") for c in ("input_tokens", "output_tokens")}
    return df.withColumns(counts).drop("messages", "generation_time_ms")


@query(GENERATED)
def generate(spark, folder):
    return shown(generation.generate(examples(ship_code(spark), folder), load_echo))


@query(GENERATED)
def generate_batched(spark, folder):
    return shown(generation.generate_batched(examples(ship_code(spark), folder), load_echo, batch_size=4))


@query(GENERATED)
def generate_resumed(spark, folder):
    """A run that stopped after some rows left its answers in a log; a second run generates the others."""
    rows, log = examples(ship_code(spark), folder), f"{shared_folder(spark)}/answer-log-{uuid.uuid4().hex}"
    generation.generate_batched(rows.where(F.col(ID) % 2 == 0), load_echo, log=log).write.format("noop").mode("overwrite").save()
    return shown(generation.generate_batched(rows, load_echo, log=log))


@query(examples_sql("SELECT id AS original_index, error IS NULL AS timed, input_tokens, output_tokens FROM generated", ECHO))
def generation_metadata(spark, folder):
    """Tokens of every row, and whether it has a time that is no less than zero."""
    rows = generation.generate_batched(examples(ship_code(spark), folder), load_echo)
    return rows.select(ID, F.coalesce(F.col("generation_time_ms") >= 0, F.lit(False)).alias("timed"),
                       *[F.col(c).cast("long").alias(c) for c in ("input_tokens", "output_tokens")])


@query(examples_sql("""SELECT count(*) FILTER (WHERE error IS NULL) AS successful_count, count(*) FILTER (WHERE error IS NOT NULL) AS failed_count,
  sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens,
  round(sum(input_tokens) / count(*), 6) AS mean_input_tokens,
  round(sum(output_tokens) / count(*), 6) AS mean_output_tokens FROM generated""", ECHO))
def generation_summary(spark, folder):
    rows = generation.generate_batched(examples(ship_code(spark), folder), load_echo)
    summary = generation.generation_summary(rows).drop("total_time_ms", "mean_time_ms")
    return rounded(summary, "mean_input_tokens", "mean_output_tokens")


@query(examples_sql("""SELECT e.id AS original_index, md5(e.text || '<|im_start|>assistant' || chr(10)) AS prompt
  FROM examples e JOIN counted c ON c.id = e.id WHERE c.split = 'validation' ORDER BY e.id LIMIT 3""", COUNTED))
def sample_prompts(spark, folder):
    split = split_documents(spark, folder).select(F.col("doc_id").alias(ID), "split")
    return generation.sample_prompts(examples(spark, folder).join(split, ID)).withColumn("prompt", F.md5("prompt"))


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Training examples with the target's visible text as the answer to judge."""
    return examples(spark, folder).withColumn("generated_response", strip_think(F.col("target_response")))


CRITERIA_ROWS = ", ".join(
    "(" + ", ".join([
        quoted(name), quoted(key), quoted(description),
        quoted("\n".join(f"{i}. {step}" for i, step in enumerate(steps, 1))),
    ]) + ")"
    for name, key, description, steps, _, _ in CRITERIA
)
PROMPTS = f""",
criteria(name, key, description, steps) AS (VALUES {CRITERIA_ROWS}),
histories AS (
  SELECT id, coalesce(string_agg(upper(role) || ': ' || content, chr(10) ORDER BY pos) FILTER (pos > 0), '') AS history
  FROM messages GROUP BY 1
),
prompts AS (
  SELECT e.id, c.key, c.name, c.steps,
         {quoted(JUDGE_OPENING)} || c.name || chr(10) || c.description || {quoted(JUDGE_STEPS)} || c.steps
         || {quoted(JUDGE_PROFILE)} || substr({prompt('r')}, {len(SYSTEM_PREAMBLE) + 2}) || {quoted(JUDGE_HISTORY)} || h.history
         || {quoted(JUDGE_ANSWER)} || regexp_replace(e.target_response, '(?s)<think>.*?</think>', '', 'g')
         || {quoted(JUDGE_REFERENCE)} || e.target_response || {quoted(JUDGE_CLOSING)} AS prompt
  FROM examples e JOIN histories h ON h.id = e.id JOIN raw r ON r.id = e.id, criteria c
)"""


@query(examples_sql("SELECT id AS original_index, key, name, md5(prompt) AS prompt FROM prompts", PROMPTS))
def judge_prompt(spark, folder):
    prompts = judging.with_judge_prompt(judging.judge_requests(judging.with_judge_context(answered(spark, folder)), 1))
    return prompts.select(ID, "criterion.key", "criterion.name", F.md5("prompt").alias("prompt"))


@query(examples_sql("SELECT id AS original_index, key, name, description, sample FROM examples, criteria, range(1, 4) AS t(sample)", PROMPTS))
def judge_requests(spark, folder):
    requests = judging.judge_requests(examples(spark, folder), 3)
    return requests.select(ID, "criterion.key", "criterion.name", "criterion.description", F.col("sample").cast("long").alias("sample"))


@query(examples_sql("SELECT key, any_value(name) AS name, any_value(steps) AS steps, count(*) AS requests FROM prompts GROUP BY 1", PROMPTS))
def criteria_table(spark, folder):
    asked = judging.judge_requests(examples(spark, folder), 1).groupBy(F.col("criterion.key").alias("key")).agg(F.count("*").alias("requests"))
    steps = F.array_join(F.transform("evaluation_steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return asked.join(judging.criteria_table(spark), "key").select("key", "name", steps.alias("steps"), "requests")


@query(examples_sql("SELECT count(*) * 6 * 20 AS calls FROM examples"))
def estimate_calls(spark, folder):
    return judging.estimate_calls(examples(spark, folder), 20)


@query(examples_sql("""SELECT id AS original_index, CASE WHEN count(*) % 3 = 0 THEN 'no company profile in the system message' END AS failure
  FROM messages GROUP BY 1"""))
def example_failure(spark, folder):
    rows = answered(spark, folder).withColumn(
        "messages", F.when(F.size("messages") % 3 == 0, F.slice("messages", F.lit(2), F.size("messages"))).otherwise(F.col("messages"))
    )
    broken = rows.withColumn("messages", F.when(F.size("messages") > 0, F.col("messages")).otherwise(
        F.array(F.struct(F.lit("user").alias("role"), F.lit("").alias("content")))
    ))
    return judging.with_example_failure(broken).select(ID, "failure")


def load_judge():
    """A judge whose score depends on the prompt's length and that refuses every eleventh length."""

    def judge(prompt):
        if len(prompt) % 11 == 0:
            raise judging.JudgeError("rate limit")
        return {"content": f"fine. SCORE: {len(prompt) % 8}", "input_tokens": len(prompt), "output_tokens": 3,
                "model_name": "stand-in", "cost_usd": 0.001, "latency_ms": 1.0}

    return judge


def no_wait(seconds):
    return None


JUDGED_PROMPTS = examples_sql("""SELECT id AS original_index, key, CASE WHEN length(prompt) % 11 <> 0 THEN 'fine. SCORE: ' || length(prompt) % 8 END AS content,
  CASE WHEN length(prompt) % 11 = 0 THEN 3 ELSE 1 END AS attempts, CASE WHEN length(prompt) % 11 = 0 THEN 'rate limit' END AS error,
  CASE WHEN length(prompt) % 11 <> 0 THEN length(prompt)::BIGINT END AS input_tokens FROM prompts""", PROMPTS)


def judge_prompts(spark, folder):
    prompts = judging.with_judge_prompt(judging.judge_requests(judging.with_judge_context(answered(ship_code(spark), folder)), 1))
    return prompts.select(ID, F.col("criterion.key").alias("key"), "prompt")


@query(JUDGED_PROMPTS)
def call_judge(spark, folder):
    judged = judging.call_judge(judge_prompts(spark, folder), load_judge, no_wait)
    return judged.select(ID, "key", "content", "attempts", "error", "input_tokens")


@query(JUDGED_PROMPTS)
def call_judge_resumed(spark, folder):
    """A run over some of the examples logs its answers; a second run over all asks only for the others."""
    asked, log = judge_prompts(spark, folder), f"{shared_folder(spark)}/judge-log-{uuid.uuid4().hex}"
    for rows in (asked.where(F.col(ID) % 3 == 0), asked):
        judged = judging.call_judge(rows, load_judge, no_wait, log=log, key=(ID, "key"))
        if rows is not asked:
            judged.write.format("noop").mode("overwrite").save()
    return judged.select(ID, "key", "content", "attempts", "error", "input_tokens")


SAMPLES = """
samples AS (
  SELECT user_id AS example_id, (user_id % 6)::VARCHAR AS task, event_type AS criterion_key, event_id AS sample,
         CASE WHEN event_id % 10 = 0 THEN 'no score here'
              ELSE 'ok SCORE: ' || least(floor(value / 20)::BIGINT, 9) END AS content, value / 1000 AS cost_usd,
         event_id % 97 = 0 AS failed
  FROM events
),
scored AS (
  SELECT *, CASE WHEN try_cast(nullif(regexp_extract(content, 'SCORE:\\s*([0-9])', 1), '') AS INTEGER) <= 5
                 THEN regexp_extract(content, 'SCORE:\\s*([0-9])', 1)::INTEGER END AS score
  FROM samples
),
scores AS (
  SELECT example_id, criterion_key, count(score) AS valid_samples, coalesce(avg(score), 0.0) AS weighted_score,
         coalesce(arg_min(content, sample) FILTER (score IS NOT NULL), 'No valid scores collected') AS justification,
         sum(cost_usd) AS total_cost_usd
  FROM scored GROUP BY 1, 2
),
weights(criterion_key, weight) AS (VALUES ('click', 1.0), ('error', 2.0), ('purchase', 1.0), ('signup', 0.5), ('view', 1.0)),
overall AS (
  SELECT example_id, count(*) AS criteria,
         coalesce(sum(weighted_score * weight) FILTER (valid_samples > 0) / sum(weight) FILTER (valid_samples > 0), 0.0) AS overall_score,
         sum(total_cost_usd) AS total_cost_usd, sum(valid_samples)::BIGINT AS total_api_calls
  FROM scores JOIN weights USING (criterion_key) GROUP BY 1
),
examples AS (SELECT example_id, any_value(task) AS task, bool_or(failed) AS failed FROM samples GROUP BY 1),
results AS (
  SELECT e.example_id, e.task, CASE WHEN failed THEN 0 ELSE criteria END AS criteria,
         CASE WHEN failed THEN 0.0 ELSE overall_score END AS overall_score,
         CASE WHEN failed THEN 0.0 ELSE total_cost_usd END AS total_cost_usd,
         CASE WHEN failed THEN 0 ELSE total_api_calls END AS total_api_calls
  FROM examples e JOIN overall o ON o.example_id = e.example_id
)"""


def samples_sql(select: str) -> str:
    return f"WITH {SAMPLES} {select}"


def weights(spark: SparkSession) -> DataFrame:
    # the weights of the five event types that stand in for criteria
    rows = [(key, key, "", [], weight, False) for key, weight in
            [("click", 1.0), ("error", 2.0), ("purchase", 1.0), ("signup", 0.5), ("view", 1.0)]]
    return spark.createDataFrame(rows, CRITERION)


def scored(spark, folder):
    return judging.with_score(judge_samples(spark, folder))


def scores(spark, folder):
    return judging.criterion_scores(scored(spark, folder))


def results(spark, folder):
    """All examples; one with a call whose number 97 divides counts as failed."""
    samples = judge_samples(spark, folder)
    examples_of = samples.groupBy("example_id").agg(F.min("task").alias("task"))
    calls = samples.withColumn("error", F.when(F.col("sample") % 97 == 0, "rate limit"))
    found = judging.example_results(scores(spark, folder), weights(spark))
    return judging.all_results(examples_of, found, judging.failed_ids(calls))


@query(samples_sql("SELECT sample, score FROM scored"))
def parse_score(spark, folder):
    return judge_samples(spark, folder).select("sample", score_of(F.col("content")).alias("score"))


@query(samples_sql("""SELECT example_id, criterion_key, string_agg(score || '=' || round(n * 1000000.0 / total)::BIGINT, ' ' ORDER BY score) AS shares
  FROM (SELECT example_id, criterion_key, score, count(*) AS n, sum(count(*)) OVER (PARTITION BY example_id, criterion_key) AS total
        FROM scored WHERE score IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def score_probabilities(spark, folder):
    entry = lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.round(e["value"] * 1000000).cast("long").cast("string"))
    found = scores(spark, folder).filter("valid_samples > 0")
    return found.select("example_id", "criterion_key",
                        F.array_join(F.transform(F.map_entries("score_probabilities"), entry), " ").alias("shares"))


@query(samples_sql("SELECT example_id, criterion_key, round(weighted_score, 6) AS weighted_score FROM scores WHERE valid_samples > 0"))
def weighted_score(spark, folder):
    found = scores(spark, folder).filter("valid_samples > 0")
    return rounded(found.select("example_id", "criterion_key", "weighted_score"), "weighted_score")


@query(samples_sql("""SELECT example_id, criterion_key, valid_samples, round(weighted_score, 6) AS weighted_score, justification,
  round(total_cost_usd, 6) AS total_cost_usd FROM scores"""))
def criterion_scores(spark, folder):
    return rounded(scores(spark, folder).drop("score_probabilities"), "weighted_score", "total_cost_usd")


@query(samples_sql("SELECT example_id, round(overall_score, 6) AS overall_score FROM overall"))
def overall_score(spark, folder):
    found = judging.example_results(scores(spark, folder), weights(spark))
    return rounded(found.select("example_id", "overall_score"), "overall_score")


RESULT = "example_id, criteria, round(overall_score, 6) AS overall_score, round(total_cost_usd, 6) AS total_cost_usd, total_api_calls"


@query(samples_sql(f"SELECT {RESULT} FROM overall"))
def example_results(spark, folder):
    return rounded(judging.example_results(scores(spark, folder), weights(spark)), "overall_score", "total_cost_usd")


@query(samples_sql(f"SELECT task, {RESULT} FROM results"))
def failed_examples(spark, folder):
    return rounded(results(spark, folder), "overall_score", "total_cost_usd")


@query(samples_sql("""SELECT round(avg(overall_score) FILTER (criteria > 0), 6) AS overall_mean, count(*) AS total_examples,
  count(*) FILTER (WHERE criteria > 0) AS valid_examples, round(sum(total_cost_usd), 6) AS total_cost_usd,
  sum(total_api_calls)::BIGINT AS total_api_calls FROM results"""))
def aggregate_overall(spark, folder):
    found = judging.aggregate_overall(results(spark, folder)).drop("error")
    return rounded(found, "overall_mean", "total_cost_usd")


@query(samples_sql("SELECT task, round(avg(overall_score), 6) AS mean, count(*) AS n FROM results WHERE criteria > 0 GROUP BY 1"))
def aggregate_by_task(spark, folder):
    return rounded(judging.aggregate_by_task(results(spark, folder)), "mean")


BY_CRITERION = """SELECT criterion_key, round(avg(weighted_score), 6) AS mean, count(*) AS n
  FROM scores JOIN results USING (example_id) WHERE valid_samples > 0 AND criteria > 0 GROUP BY 1"""


@query(samples_sql(BY_CRITERION))
def aggregate_by_criterion(spark, folder):
    return rounded(judging.aggregate_by_criterion(scores(spark, folder), results(spark, folder)), "mean")


@query(samples_sql("""SELECT example_id, criterion_key,
  coalesce(string_agg(score, ' ' ORDER BY sample) FILTER (score IS NOT NULL), '') AS raw_scores FROM scored GROUP BY 1, 2"""))
def raw_scores(spark, folder):
    found = judging.criterion_scores(scored(spark, folder), 20)
    return found.select("example_id", "criterion_key", F.array_join(F.col("raw_scores").cast("array<string>"), " ").alias("raw_scores"))
