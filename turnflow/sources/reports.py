"""Results, reports and statistics as JSON."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnflow.constants import CRITERIA
from turnflow.operators.generation import generation_summary
from turnflow.operators.judging import (
    aggregate_by_criterion, aggregate_by_task, aggregate_overall, all_results, criterion_scores, example_results,
    failed_ids, with_score,
)
from turnflow.plans.shared import written
from turnflow.sources.json_array import read_entries
from turnflow.sources.paths import files_under


def write_stats(df: DataFrame, path: str) -> None:
    """Save statistics, one JSON object per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def dated(path: str, day: date | None = None) -> str:
    return f"{path}_{(day or date.today()).strftime('%Y%m%d')}"


def write_evaluation(
    df: DataFrame, path: str, include_messages: bool = True, day: date | None = None, config: dict | None = None
) -> str:
    """Save generation results under a dated name, with their summary and the settings beside them."""
    target = dated(path, day)
    rows = df if include_messages else df.drop("messages")
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{target}/results")
    # the summary is taken from the saved rows, so nothing is generated again
    numbers = T.StructType([f for f in df.schema if not isinstance(f.dataType, T.ArrayType)])
    saved = df.sparkSession.read.schema(numbers).json(f"{target}/results")
    write_stats(generation_summary(saved), f"{target}/summary")
    if config:
        write_stats(_settings(df.sparkSession, config), f"{target}/config")
    return target


def _settings(spark: SparkSession, config: dict) -> DataFrame:
    return spark.range(1).select(*[F.lit(value).alias(name) for name, value in config.items()])


def read_evaluation(
    spark: SparkSession, path: str, schema: T.StructType, max_examples: int | None = None, multi_line: bool = False
) -> DataFrame:
    """Load results with fields `schema`: JSON lines, or a `multi_line` file.

    Such a file may hold a list of results or an object with the list under `results`; it is read as a stream, result
    by result, by workers that reach it. `max_examples` takes the first in the order of the files and of the results
    in them, and of a `multi_line` file reads no more.
    """
    if multi_line:
        entries = read_entries(spark, files_under(spark, path), "results", max_examples)
        rows = entries.select("file", "at", F.from_json("entry", schema).alias("r"))
        place = ["file", "at"]
    else:
        read = spark.read.schema(schema).json(path)
        # a text file tells where its parts begin; within a part ids grow row by row
        place = ["file", "part", "at"]
        rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
                           F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in read.columns]).alias("r"))
    if max_examples is not None:
        rows = rows.orderBy(*place).limit(max_examples)
    return rows.select("r.*")


def nested_results(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results with their criterion scores, at most one per criterion, as an array."""
    names = F.create_map(*[F.lit(x) for name, key, *_ in CRITERIA for x in (key, name)])
    probabilities = F.map_from_entries(F.transform(
        F.map_entries("score_probabilities"), lambda e: F.struct(e["key"].cast("string"), e["value"])
    ))
    raw = ["raw_scores"] if "raw_scores" in scores.columns else []
    entry = F.struct(
        F.coalesce(F.try_element_at(names, F.col("criterion_key")), F.col("criterion_key")).alias("criterion_name"),
        "criterion_key", *raw, probabilities.alias("score_probabilities"), "weighted_score", "justification", "total_cost_usd",
    )

    def by_key(a, b):
        return F.when(a["criterion_key"] < b["criterion_key"], -1).when(a["criterion_key"] > b["criterion_key"], 1).otherwise(0)

    per_example = scores.groupBy("example_id").agg(F.array_sort(F.collect_list(entry), by_key).alias("criterion_scores"))
    none = F.array().cast(per_example.schema["criterion_scores"].dataType)
    return results.join(per_example, "example_id", "left").withColumn(
        "criterion_scores", F.when(F.col("criteria") > 0, F.col("criterion_scores")).otherwise(none)
    ).drop("criteria").withColumnRenamed("task", "task_type")


def report_judged(
    examples: DataFrame, judged: DataFrame, criteria: DataFrame, config: dict, path: str, samples: int | None = None
) -> None:
    """Roll up what `call_judge` returned and save the report; every call is made once.

    `examples` have `example_id`, `task` and what `with_example_failure` needs; those that
    cannot be judged, or with a failed call, are zero rows.
    """
    judged = written(judged, "judged")
    scores = criterion_scores(with_score(judged), samples)
    results = all_results(examples, example_results(scores, criteria), failed_ids(judged, examples))
    write_judge_report(results, scores, config, path)


def write_judge_report(results: DataFrame, scores: DataFrame, config: dict, path: str) -> None:
    """Save nested results, the call settings with totals, and the three aggregates.

    Results and scores are written once and read back, so all five parts agree and no call
    of a judge behind them is made twice.
    """
    results, scores = written(results, "judge-results"), written(scores, "judge-scores")
    nested_results(results, scores).write.mode("overwrite").json(f"{path}/results")
    totals = aggregate_overall(results)
    settings = totals.select(
        *[F.lit(value).alias(name) for name, value in config.items()], "total_examples", "total_api_calls", "total_cost_usd"
    )
    write_stats(settings, f"{path}/evaluation_metadata")
    write_stats(totals, f"{path}/aggregate_metrics/overall")
    write_stats(aggregate_by_task(results), f"{path}/aggregate_metrics/by_task")
    write_stats(aggregate_by_criterion(scores, results), f"{path}/aggregate_metrics/by_criterion")
