"""Round trips through every source and sink, over whole tables."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.explore import SPLIT_DOCUMENTS, rounded, split_documents
from catalog.generation import BY_CRITERION, ECHO, load_echo, results, samples_sql, scores
from catalog.inputs import examples, raw
from catalog.metrics import log_sql
from catalog.registry import query, ship_code
from catalog.sql import examples_sql, raw_sql
from turnflow.operators.generation import generate_batched
from turnflow.plans.shared import shared_folder
from turnflow.sources import metric_log as metric_logs
from turnflow.sources import reports, splits, traces
from turnflow.sources.bridge import metric_log


def place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def same_trace(df):
    return df.select(F.col("primary id").alias("id"), "task", F.size("trace").cast("long").alias("messages"),
                     F.md5(F.array_join(F.transform("trace", lambda m: m["content"]), "|")).alias("content"))


@query(raw_sql("""SELECT r.id, any_value(r.task) AS task, CASE WHEN any_value(r.has_trace) THEN any_value(r.n_messages)::BIGINT END AS messages,
  CASE WHEN any_value(r.has_trace) THEN md5(coalesce(string_agg(m.content, '|' ORDER BY m.turn, m.part), '')) END AS content
  FROM raw r LEFT JOIN raw_messages m ON m.id = r.id GROUP BY r.id"""))
def read_traces(spark, folder):
    source, cache = place(spark, "traces"), place(spark, "traces-cache")
    raw(spark, folder).write.parquet(source)
    traces.read_traces(spark, source, cache)
    return same_trace(traces.read_traces(spark, source, cache))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'")
def write_and_read_split(spark, folder):
    path = place(spark, "split")
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "n_chars")
    splits.write_split(documents.filter("lang = 'en'"), path, "english")
    return splits.read_split(spark, path, "english")


@query(f"WITH {SPLIT_DOCUMENTS} SELECT doc_id, n_chars, split FROM split_documents")
def write_and_read_splits(spark, folder):
    path = place(spark, "splits")
    splits.write_splits(split_documents(spark, folder).select("doc_id", "n_chars", "split"), path, save_stats=False)
    return splits.read_splits(spark, path)


@query(f"WITH {SPLIT_DOCUMENTS} SELECT split, count(*) AS num_examples, count(DISTINCT lang) AS tasks FROM split_documents GROUP BY 1")
def written_split_statistics(spark, folder):
    path = place(spark, "splits")
    splits.write_splits(split_documents(spark, folder).select("doc_id", F.col("lang").alias("task"), "split"), path)
    stats = spark.read.schema("split string, num_examples bigint").json(f"{path}/{splits.STATISTICS}")
    tasks = spark.read.schema("split string, task string").json(f"{path}/{splits.TASKS}").groupBy("split").agg(F.count("*").alias("tasks"))
    return stats.join(tasks, "split")


@query(examples_sql("SELECT id AS original_index, task, generated_response, error, input_tokens FROM generated", ECHO))
def write_and_read_evaluation(spark, folder):
    generated = generate_batched(examples(ship_code(spark), folder), load_echo)
    target = reports.write_evaluation(generated, place(spark, "evaluation"), include_messages=False)
    schema = T.StructType([f for f in generated.schema if f.name != "messages"])
    saved = reports.read_evaluation(spark, f"{target}/results", schema)
    return saved.select("original_index", "task", "generated_response", "error", F.col("input_tokens").cast("long").alias("input_tokens"))


@query(examples_sql("SELECT count(*) FILTER (WHERE error IS NULL) AS successful_count, count(*) FILTER (WHERE error IS NOT NULL) AS failed_count FROM generated", ECHO))
def written_evaluation_summary(spark, folder):
    generated = generate_batched(examples(ship_code(spark), folder), load_echo)
    target = reports.write_evaluation(generated, place(spark, "evaluation"))
    return spark.read.schema("successful_count bigint, failed_count bigint").json(f"{target}/summary")


REPORT = "example_id bigint, task_type string, overall_score double, criterion_scores array<struct<criterion_key:string,weighted_score:double>>"


@query(samples_sql("""SELECT r.example_id, task, round(overall_score, 6) AS overall_score,
  CASE WHEN criteria > 0 THEN (SELECT string_agg(criterion_key, ' ' ORDER BY criterion_key) FROM scores s WHERE s.example_id = r.example_id)
       ELSE '' END AS criteria FROM results r"""))
def write_judge_report(spark, folder):
    path = place(spark, "judge-report")
    reports.write_judge_report(results(spark, folder), scores(spark, folder), {"model": "stand-in", "num_samples": 20}, path)
    saved = spark.read.schema(REPORT).json(f"{path}/results")
    keys = F.array_join(F.transform("criterion_scores", lambda c: c["criterion_key"]), " ")
    return rounded(saved.select("example_id", F.col("task_type").alias("task"), "overall_score", keys.alias("criteria")), "overall_score")


PARTS = f"""SELECT 'overall' AS part, 'all' AS name, round(avg(overall_score) FILTER (criteria > 0), 6) AS mean,
  count(*) AS n, round(sum(total_cost_usd), 6) AS cost, sum(total_api_calls)::BIGINT AS calls FROM results
  UNION ALL SELECT 'metadata', 'stand-in', 20.0, count(*), round(sum(total_cost_usd), 6), sum(total_api_calls)::BIGINT FROM results
  UNION ALL SELECT 'task', task, round(avg(overall_score), 6), count(*), NULL, NULL FROM results WHERE criteria > 0 GROUP BY 2
  UNION ALL SELECT 'criterion', criterion_key, mean, n, NULL, NULL FROM ({BY_CRITERION})"""


@query(samples_sql(PARTS))
def judge_report_parts(spark, folder):
    """The four other parts of a saved report, read back."""
    path = place(spark, "judge-report")
    reports.write_judge_report(results(spark, folder), scores(spark, folder), {"model": "stand-in", "num_samples": 20}, path)
    sums = "total_examples bigint, total_api_calls bigint, total_cost_usd double"

    def part(where, schema, name, kind, mean, n, cost="cast(null AS double)", calls="cast(null AS bigint)"):
        return spark.read.schema(schema).json(f"{path}/{where}").selectExpr(
            f"'{kind}' AS part", f"{name} AS name", f"round({mean}, 6) AS mean", f"{n} AS n",
            f"round({cost}, 6) AS cost", f"{calls} AS calls")

    totals = ("total_examples", "total_cost_usd", "total_api_calls")
    found = [
        part("aggregate_metrics/overall", f"overall_mean double, {sums}", "'all'", "overall", "overall_mean", *totals),
        part("evaluation_metadata", f"model string, num_samples double, {sums}", "model", "metadata", "num_samples", *totals),
        part("aggregate_metrics/by_task", "task string, mean double, n bigint", "task", "task", "mean", "n"),
        part("aggregate_metrics/by_criterion", "criterion_key string, mean double, n bigint", "criterion_key", "criterion", "mean", "n"),
    ]
    return reduce(DataFrame.unionByName, found)


@query(log_sql("SELECT run_id, tag, step, value FROM log"))
def read_metric_log(spark, folder):
    path = place(spark, "metric-log")
    metric_log(spark, folder).write.parquet(path)
    return metric_logs.read_metric_log(spark, path)


@query(log_sql("SELECT run_id, tag, step, value FROM log"))
def metric_log_written_last(spark, folder):
    """A log whose points were written twice, first with other values."""
    path, log = place(spark, "metric-log"), metric_log(spark, folder)
    log.withColumn("value", F.col("value") + F.col("step") % 3 - 1).write.parquet(path)
    log.write.mode("append").parquet(path)
    return metric_logs.read_metric_log(spark, path)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def write_stats(spark, folder):
    path = place(spark, "stats")
    counts = spark.read.parquet(f"{folder}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"))
    reports.write_stats(counts, path)
    return spark.read.schema("lang string, n bigint").json(path)
