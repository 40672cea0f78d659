"""Batch generation: one answer per training example, by a generator the user supplies."""

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnflow.constants import TRAINING_LENGTH
from turnflow.functions.chat import render_prompt
from turnflow.functions.text import trim_at_stop
from turnflow.functions.tokens import count_tokens
from turnflow.operators.checks import require_columns, require_rows
from turnflow.plans.row_identity import with_scan_position
from turnflow.schemas import GENERATED
from turnflow.sources.answer_log import with_answers

# load() runs once per partition and returns answer(list of message lists) -> list of texts
Answer = Callable[[list[list[dict]]], list[str]]
Load = Callable[[], Answer]

ANSWER = T.StructType([GENERATED[c] for c in ("generated_response", "error", "generation_time_ms")])


def _answered(answer: Answer, rows: list[list[dict]]) -> tuple[list[str | None], list[str | None], list[float | None]]:
    """Answers, errors and times of one batch; a failed batch is tried again row by row."""
    start = time.perf_counter()
    try:
        texts = answer(rows)
        if len(texts) != len(rows):
            raise ValueError(f"expected {len(rows)} answers, got {len(texts)}")
    except Exception as error:
        if len(rows) == 1:
            return [None], [str(error)], [None]
        single = [_answered(answer, [row]) for row in rows]
        return [s[0][0] for s in single], [s[1][0] for s in single], [s[2][0] for s in single]
    spent = (time.perf_counter() - start) * 1000 / len(rows)
    return list(texts), [None] * len(rows), [round(spent, 2)] * len(rows)


def _responding(load: Load, batch_size: int):
    def responding():
        answer = load()

        def respond(conversations: list[list[dict]]) -> Iterator[list[dict]]:
            for at in range(0, len(conversations), batch_size):
                made = zip(*_answered(answer, conversations[at : at + batch_size]), strict=True)
                yield [dict(zip(ANSWER.names, one, strict=True)) for one in made]

        return respond

    return responding


def _input(df: DataFrame) -> DataFrame:
    require_columns(df, ["messages"])
    if "original_index" not in df.columns:
        df = with_scan_position(df, "original_index")
    filled = df.select(
        F.col("original_index").cast("long").alias("original_index"),
        (F.coalesce("task", F.lit("unknown")) if "task" in df.columns else F.lit("unknown")).alias("task"),
        F.col("messages"),
        (F.coalesce("target_response", F.lit("")) if "target_response" in df.columns else F.lit("")).alias("target_response"),
    )
    return require_rows(filled, "dataset is empty")


def generate_batched(
    df: DataFrame, load: Load, batch_size: int = 4, stops: tuple[str, ...] = (), max_length: int = TRAINING_LENGTH,
    log: str | None = None,
) -> DataFrame:
    """One answer per row, in batches inside each partition, with its metadata.

    A row that fails keeps its place with a null answer and the error. `load` runs once per partition that has
    rows to answer. Only the messages are turned into Python objects; all columns pass through unchanged. With `log`, a
    folder that workers reach, answers are logged as they come under `original_index`, and a retried task, a second
    evaluation or a restart generates only what lacks or failed. Without it, write the result before using
    it more than once: a lost partition that nobody wrote is generated again.
    """
    rows = with_answers(_input(df), "messages", _responding(load, batch_size), ANSWER, log, ("original_index",))
    return with_generation_metadata(
        rows.withColumn("generated_response", trim_at_stop(F.col("generated_response"), list(stops))), max_length
    )


def generate(
    df: DataFrame, load: Load, stops: tuple[str, ...] = (), max_length: int = TRAINING_LENGTH, log: str | None = None
) -> DataFrame:
    """`generate_batched` one row at a time."""
    return generate_batched(df, load, 1, stops, max_length, log)


def with_generation_metadata(df: DataFrame, max_length: int = TRAINING_LENGTH) -> DataFrame:
    """Add the tokens of the truncated prompt and of the answer; null for a failed row."""
    good = F.col("error").isNull()
    prompt = F.least(count_tokens(render_prompt(F.col("messages"))), F.lit(max_length))
    return df.withColumns({
        "input_tokens": F.when(good, prompt),
        "output_tokens": F.when(good, count_tokens(F.col("generated_response"))),
    })


def generation_summary(df: DataFrame) -> DataFrame:
    """Successes, failures, time and tokens; the averages divide by all rows."""
    rows = F.count("*")

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return df.agg(
        F.count_if(F.col("error").isNull()).alias("successful_count"),
        F.count_if(F.col("error").isNotNull()).alias("failed_count"),
        total("generation_time_ms").cast("double").alias("total_time_ms"),
        F.try_divide(total("generation_time_ms"), rows).alias("mean_time_ms"),
        total("input_tokens").alias("total_input_tokens"),
        total("output_tokens").alias("total_output_tokens"),
        F.try_divide(total("input_tokens"), rows).alias("mean_input_tokens"),
        F.try_divide(total("output_tokens"), rows).alias("mean_output_tokens"),
    )


def sample_prompts(df: DataFrame, n: int = 3, split: str = "validation") -> DataFrame:
    """The first `n` prompts of a split, for review."""
    chosen = df.filter(F.col("split") == split) if "split" in df.columns else df
    return chosen.orderBy("original_index").limit(n).select(
        "original_index", render_prompt(F.col("messages")).alias("prompt")
    )
