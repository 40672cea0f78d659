"""Judge scoring: requests, answers, scores and their roll-ups."""

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.constants import (
    CRITERIA, JUDGE_ANSWER, JUDGE_CLOSING, JUDGE_HISTORY, JUDGE_OPENING, JUDGE_PROFILE, JUDGE_REFERENCE, JUDGE_STEPS,
    NO_VALID_SCORES,
)
from turnflow.functions.profile import profile_lines, profile_map
from turnflow.functions.text import parse_score
from turnflow.operators.checks import require_columns
from turnflow.plans.shared import with_computed_once
from turnflow.schemas import CRITERION, JUDGED
from turnflow.sources.answer_log import with_answers

SCORES = range(6)
MAX_TRIES = 3


class JudgeError(Exception):
    """A failed call of the judge that is worth another try."""


def criteria_table(spark: SparkSession) -> DataFrame:
    """The six judging criteria."""
    return spark.createDataFrame(CRITERIA, CRITERION)


def with_judge_context(examples: DataFrame) -> DataFrame:
    """Add `profile_text` and `history_text`, which all criteria of an example share."""
    require_columns(examples, ["messages", "generated_response", "target_response"])
    system = F.get("messages", F.lit(0))["content"]
    later = F.slice("messages", F.lit(2), F.greatest(F.size("messages") - 1, F.lit(0)))
    spoken = F.transform(later, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    with_profile = with_computed_once(examples, "profile_text", profile_lines(profile_map(system)))
    return with_computed_once(with_profile, "history_text", F.array_join(spoken, "\n"))


def judge_prompt(
    name: Column, description: Column, steps: Column, profile: Column, history: Column, answer: Column, reference: Column
) -> Column:
    """Evaluation prompt for one criterion."""
    numbered = F.transform(steps, lambda step, i: F.concat((i + 1).cast("string"), F.lit(". "), step))
    return F.concat(
        F.lit(JUDGE_OPENING), name, F.lit("\n"), description,
        F.lit(JUDGE_STEPS), F.array_join(numbered, "\n"),
        F.lit(JUDGE_PROFILE), profile,
        F.lit(JUDGE_HISTORY), history,
        F.lit(JUDGE_ANSWER), answer,
        F.lit(JUDGE_REFERENCE), reference,
        F.lit(JUDGE_CLOSING),
    )


def _criteria_array() -> Column:
    return F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.lit(key).alias("key"), F.lit(description).alias("description"),
            F.array(*[F.lit(step) for step in steps]).alias("steps"),
        )
        for name, key, description, steps, _, _ in CRITERIA
    ])


def with_example_failure(df: DataFrame) -> DataFrame:
    """Add `failure`, null for an example that can be judged."""
    require_columns(df, ["messages", "generated_response", "target_response"])
    system = F.get("messages", F.lit(0))["content"]
    return df.withColumn(
        "failure",
        F.when(F.coalesce(F.size("messages"), F.lit(0)) <= 0, "messages must be a non-empty list")
        .when(profile_map(system).isNull(), "no company profile in the system message")
        .when(F.col("generated_response").isNull(), "no generated response"),
    )


def judge_requests(examples: DataFrame, samples: int = 20) -> DataFrame:
    """One row per example, criterion and sample number; made row by row, not by a join.

    The prompt is built per criterion, see `with_judge_prompt`, so samples are exploded after it.
    """
    if samples < 1:
        raise ValueError(f"samples must be at least 1, got {samples}")
    return (
        examples.withColumn("criterion", F.explode(_criteria_array()))
        .withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    )


def with_judge_prompt(requests: DataFrame) -> DataFrame:
    """Add `prompt` to the requests made from examples `with_judge_context`."""
    c = F.col("criterion")
    return requests.withColumn("prompt", judge_prompt(
        c["name"], c["description"], c["steps"], F.col("profile_text"), F.col("history_text"),
        F.col("generated_response"), F.col("target_response"),
    ))


def estimate_calls(examples: DataFrame, samples: int = 20) -> DataFrame:
    """Calls that judging a table will make."""
    return examples.agg((F.count("*") * len(CRITERIA) * samples).alias("calls"))


def _call(judge: Callable[[str], dict], prompt: str, wait: Callable[[float], None]) -> dict:
    """One judged answer, or its error.

    A JudgeError and an empty answer are tried again, with growing waits; any other error is not.
    """
    if prompt is None:
        return {"attempts": 0, "error": "no prompt"}
    for attempt in range(1, MAX_TRIES + 1):
        try:
            answer = judge(prompt)
            if answer.get("content") is None:
                raise JudgeError("the judge returned empty content")
            return {**answer, "attempts": attempt, "error": None}
        except JudgeError as error:
            failure = {"attempts": attempt, "error": str(error)}
            wait(2**attempt)
        except Exception as error:
            return {"attempts": attempt, "error": str(error) or type(error).__name__}
    return failure


def call_judge(
    requests: DataFrame, load: Callable[[], Callable[[str], dict]], wait: Callable[[float], None] = time.sleep,
    log: str | None = None, key: tuple[str, ...] = (),
) -> DataFrame:
    """Call the judge once per row of `prompt`.

    The partitions of `requests` set how many calls run at a time. An error of the judge, of whatever kind, is
    the `error` of its row; a null prompt is not sent. With `log`, a folder that workers reach, every answer is
    logged as it comes under its `key` (example, criterion and sample): a killed task, a second evaluation or a
    restart pays for no call again, but those that failed. Without it, write the result before rolling it
    up: a lost partition that nobody wrote is paid for again.
    """

    def responding():
        judge = load()

        def respond(prompts: list[str]) -> Iterator[list[dict]]:
            for prompt in prompts:
                yield [_call(judge, prompt, wait)]

        return respond

    return with_answers(requests, "prompt", responding, JUDGED, log, key, keep=False)


def with_score(samples: DataFrame) -> DataFrame:
    """Add `score`; null where the answer has none or one above 5."""
    return samples.withColumn("score", parse_score(F.col("content")))


def score_probabilities(counts: Column, valid: Column) -> Column:
    """Share of each score among the valid ones, as entries in score order."""
    entries = F.transform(counts, lambda n, score: F.struct(score.alias("score"), F.try_divide(n, valid).alias("p")))
    return F.filter(entries, lambda e: e["p"] > 0)


def weighted_score(probabilities: Column) -> Column:
    """Sum of score times probability; 0 without scores."""
    return F.aggregate(probabilities, F.lit(0.0), lambda total, e: total + e["score"] * e["p"])


def criterion_scores(scored: DataFrame, samples: int | None = None) -> DataFrame:
    """Per example and criterion: valid scores, probabilities, weighted score, text, cost and time.

    Each row carries six counters and not its samples, so an example may have any number
    of them. With `samples`, as many as `judge_requests` made, the list `raw_scores` of all
    valid scores in sample order is added. `latency_ms` of the calls, if there, is summed up.
    """
    valid = F.col("score").isNotNull()
    first_text = F.min_by("content", F.when(valid & (F.col("content") != ""), F.col("sample")))
    columns = [
        F.count_if(valid).alias("valid_samples"),
        *[F.count_if(F.col("score") == s).alias(f"_n{s}") for s in SCORES],
        first_text.alias("_text"),
        F.sum("cost_usd").alias("total_cost_usd"),
    ]
    if "latency_ms" in scored.columns:
        columns.append(F.sum("latency_ms").alias("evaluation_time_ms"))
    if samples is not None:
        numbered = F.when(valid, F.struct("sample", "score"))
        columns.append(F.array_sort(F.collect_list(numbered)).alias("_raw"))
    rows = scored.groupBy("example_id", "criterion_key").agg(*columns)
    counts = F.array(*[F.col(f"_n{s}") for s in SCORES])
    shaped = rows.withColumn("probabilities", score_probabilities(counts, F.col("valid_samples"))).withColumns({
        "weighted_score": weighted_score(F.col("probabilities")),
        "score_probabilities": F.map_from_entries("probabilities"),
        "justification": F.when(F.col("valid_samples") > 0, F.coalesce("_text", F.lit(""))).otherwise(NO_VALID_SCORES),
    })
    if samples is not None:
        shaped = shaped.withColumn("raw_scores", F.transform("_raw", lambda r: r["score"]))
    return shaped.drop(*[f"_n{s}" for s in SCORES], "_text", "_raw", "probabilities")


def _weights(criteria: DataFrame) -> DataFrame:
    return criteria.select(F.col("key").alias("criterion_key"), "weight")


def overall_score(score: Column, weight: Column, applicable: Column) -> Column:
    """Weighted mean over the applicable criteria, as an aggregate; 0 without any weight."""
    weights = F.sum(F.when(applicable, weight))
    return F.coalesce(F.try_divide(F.sum(F.when(applicable, score * weight)), weights), F.lit(0.0))


def example_results(scores: DataFrame, criteria: DataFrame) -> DataFrame:
    """Per example: overall score, cost and time of all samples, and calls that gave a score.

    Scores of a criterion that the table lacks have no weight; their cost and calls count.
    """
    valid = (F.col("valid_samples") > 0) & F.col("weight").isNotNull()
    time_spent = [F.sum("evaluation_time_ms").alias("evaluation_time_ms")] if "evaluation_time_ms" in scores.columns else []
    return scores.join(_weights(criteria), "criterion_key", "left").groupBy("example_id").agg(
        F.count("*").alias("criteria"),
        overall_score(F.col("weighted_score"), F.col("weight"), valid).alias("overall_score"),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.sum("valid_samples").alias("total_api_calls"),
        *time_spent,
    )


def judgeable(examples: DataFrame) -> DataFrame:
    """Examples that can be judged; the others are known before any call is made."""
    return with_example_failure(examples).filter(F.col("failure").isNull()).drop("failure")


def failed_ids(judged: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Examples with a call that failed after its last try; all of such an example fails.

    With `examples`, those that cannot be judged are failed too.
    """
    failed = judged.filter(F.col("error").isNotNull()).select("example_id")
    if examples is not None:
        failed = failed.union(with_example_failure(examples).filter(F.col("failure").isNotNull()).select("example_id"))
    return failed.distinct()


def all_results(examples: DataFrame, results: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Every example with its result; a failed one is a zero row without criterion scores."""
    if failed is not None:
        results = results.join(failed, "example_id", "left_anti")
    zero = {"criteria": 0, "overall_score": 0.0, "total_cost_usd": 0.0, "total_api_calls": 0}
    if "evaluation_time_ms" in results.columns:
        zero["evaluation_time_ms"] = 0.0
    return examples.select("example_id", F.coalesce("task", F.lit("unknown")).alias("task")).join(
        results, "example_id", "left"
    ).fillna(zero)


def aggregate_overall(results: DataFrame) -> DataFrame:
    """Mean over the examples with criterion scores; cost and calls over all examples."""
    scored = F.col("criteria") > 0
    return results.agg(
        F.when(F.count("*") == 0, "No results to aggregate").alias("error"),
        F.coalesce(F.avg(F.when(scored, F.col("overall_score"))), F.lit(0.0)).alias("overall_mean"),
        F.count("*").alias("total_examples"),
        F.count_if(scored).alias("valid_examples"),
        F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.sum("total_api_calls"), F.lit(0)).alias("total_api_calls"),
    )


def aggregate_by_task(results: DataFrame) -> DataFrame:
    """Mean score and number per task, over the examples with criterion scores."""
    return results.filter(F.col("criteria") > 0).groupBy("task").agg(
        F.avg("overall_score").alias("mean"), F.count("*").alias("n")
    )


def aggregate_by_criterion(scores: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Mean weighted score and number per criterion, over those with a valid score.

    With `results`, only scores of examples that kept their criterion scores count; a failed
    example has none.
    """
    if results is not None:
        scores = scores.join(results.filter(F.col("criteria") > 0).select("example_id"), "example_id", "left_semi")
    return scores.filter(F.col("valid_samples") > 0).groupBy("criterion_key").agg(
        F.avg("weighted_score").alias("mean"), F.count("*").alias("n")
    )
