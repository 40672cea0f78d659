"""Raw examples (one row per conversation, messages in a `trace` array) to training examples.

Every step works inside a row, so shaping needs no shuffle. Conversations stored one row
per message go through `turnflow.operators.turns` instead.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnflow.functions.messages import calls_tools, map_role, wrap_think
from turnflow.functions.profile import company_profile, system_prompt
from turnflow.functions.text import clean_text, is_blank
from turnflow.operators.checks import require_columns, require_rows
from turnflow.plans.ordering import with_position
from turnflow.plans.row_identity import with_scan_position
from turnflow.plans.shared import with_computed_once

NO_TRACE = "missing trace"
NO_TURN = "no valid turn"
NO_ANSWER = "does not end with an assistant message"


def with_turns(df: DataFrame) -> DataFrame:
    """Add `turns`: the non-blank messages of `trace` with role and cleaned content."""
    kept = F.filter("trace", lambda m: m.isNotNull() & ~is_blank(m["content"]))
    return with_computed_once(
        df,
        "turns",
        F.transform(
            kept,
            lambda m: F.struct(
                map_role(m["type"], m["role"]).alias("role"),
                clean_text(m["content"]).alias("content"),
                m["type"].alias("type"),
                calls_tools(m["tool_calls"]).alias("has_tool_calls"),
            ),
        ),
    )


def has_tool_calls(trace: Column) -> Column:
    """True if any raw message, blank ones included, calls a tool."""
    return F.coalesce(F.exists(trace, lambda m: calls_tools(m["tool_calls"])), F.lit(False))


def with_merged_turns(df: DataFrame) -> DataFrame:
    """Add `merged`: `turns` as (role, content) with each run of assistant turns joined."""
    parts = F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"),
        F.when(t["role"] == "assistant", wrap_think(t["type"], t["content"])).otherwise(t["content"]).alias("content"),
    ))
    positions = F.when(F.size("_parts") > 0, F.sequence(F.lit(0), F.size("_parts") - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def role_at(i: Column) -> Column:
        return F.get(F.col("_parts"), i)["role"]

    def starts_message(i: Column) -> Column:
        continues = (i > 0) & (role_at(i) == "assistant") & (role_at(i - 1) == "assistant")
        return ~F.coalesce(continues, F.lit(False))

    def message(start: Column, nth: Column) -> Column:
        end = F.coalesce(F.get(F.col("_starts"), nth + 1), F.size("_parts"))
        run = F.slice("_parts", start + 1, end - start)
        return F.struct(
            role_at(start).alias("role"),
            F.array_join(F.transform(run, lambda p: p["content"]), "").alias("content"),
        )

    cut = df.withColumn("_parts", parts).withColumn("_starts", F.filter(positions, starts_message))
    return with_computed_once(cut, "merged", F.transform("_starts", message)).drop("_parts", "_starts")


def with_messages(df: DataFrame) -> DataFrame:
    """Add `messages`: the system message, then the merged turns."""
    system = F.struct(F.lit("system").alias("role"), system_prompt(company_profile(df)).alias("content"))
    return with_merged_turns(df).withColumn("messages", F.concat(F.array(system), "merged"))


def with_reject_reason(df: DataFrame) -> DataFrame:
    """Add `reject_reason`, null for a conversation that gives a training example.

    The last turn has the role of the last message, so unusable rows are known, and can
    be filtered out, before any message is built.
    """
    last_role = F.try_element_at(F.col("turns"), F.lit(-1))["role"]
    return df.withColumn(
        "reject_reason",
        F.when(F.col("trace").isNull(), NO_TRACE)
        .when(F.size("turns") == 0, NO_TURN)
        .when(last_role != "assistant", NO_ANSWER),
    )


def split_target(df: DataFrame) -> DataFrame:
    """Move the last message into `target_response`."""
    return df.withColumn("target_response", F.element_at("messages", -1)["content"]).withColumn(
        "messages", F.slice("messages", F.lit(1), F.size("messages") - 1)
    )


def with_turn_counts(df: DataFrame) -> DataFrame:
    """Add the turn counters over `messages`; the system message is no turn."""

    def count(role: str) -> Column:
        return F.size(F.filter("messages", lambda m: m["role"] == role))

    return df.withColumns({
        "num_turns": F.size("messages") - 1,
        "num_user_turns": count("user"),
        "num_assistant_turns": count("assistant"),
        "num_tool_turns": count("tool"),
    })


def keep_correct(df: DataFrame) -> DataFrame:
    """Rows whose `correct` is true; a null counts as not correct."""
    return df.filter(F.col("correct"))


def with_original_index(df: DataFrame, key: str | None = None) -> DataFrame:
    """Add `original_index`, the position of every row in the input as it lies, or in the order of `key` if one is named.

    Rows are numbered themselves, so rows with equal or null keys keep numbers of their own. A table read from
    Parquet is numbered on the scan; the order of a key needs a sort.
    """
    if key is None:
        return with_scan_position(df, "original_index")
    return with_position(df.withColumn("_key", F.col(f"`{key}`")), ["_key"], name="original_index").drop("_key")


def shape_examples(df: DataFrame) -> DataFrame:
    """All shaping steps for one row each; `reject_reason` tells the unusable rows."""
    require_columns(df, ["trace"])
    return with_messages(with_reject_reason(with_turns(df)))


def _or_default(df: DataFrame, column: str, default) -> Column:
    return F.col(f"`{column}`") if column in df.columns else F.lit(default)


def training_examples(shaped: DataFrame) -> DataFrame:
    """The usable rows of `shape_examples` in the schema of training examples."""
    index = next((F.col(f"`{c}`") for c in ("index", "primary id") if c in shaped.columns), F.lit(-1))
    good = with_turn_counts(split_target(shaped.filter(F.col("reject_reason").isNull())))
    return good.select(
        "messages",
        "target_response",
        "num_turns",
        "num_user_turns",
        "num_assistant_turns",
        "num_tool_turns",
        index.cast("long").alias("original_index"),
        _or_default(shaped, "task", "").alias("task"),
        _or_default(shaped, "reference answer", "").alias("reference_answer"),
        _or_default(shaped, "correct", None).cast("boolean").alias("correct"),
        _or_default(shaped, "assistant model name", "").alias("assistant_model"),
    )


def preprocess(df: DataFrame, key: str | None = None) -> DataFrame:
    """Correct, usable conversations as training examples.

    Rows are numbered before filtering, as they lie in the input, or in the order of `key`. Read from Parquet, the
    number is part of the scan, so the filter on `correct` reaches the reader and no conversation is exchanged.
    """
    require_columns(df, ["correct", "trace"])
    numbered = with_original_index(df, key)
    shaped = shape_examples(keep_correct(numbered)).withColumn("index", F.col("original_index"))
    require_rows(shaped.filter(F.col("reject_reason").isNull()), "all examples were filtered during preprocessing")
    return training_examples(shaped)


def rejected_examples(df: DataFrame, key: str = "primary id") -> DataFrame:
    """Correct rows that give no training example, with the reason."""
    shaped = with_reject_reason(with_turns(keep_correct(df)))
    return shaped.filter(F.col("reject_reason").isNotNull()).select(F.col(f"`{key}`").alias("id"), "reject_reason")


def preprocess_report(df: DataFrame) -> DataFrame:
    """Processed, filtered and failed rows, and the share processed of all input rows."""
    shaped = with_reject_reason(with_turns(df))
    correct = F.coalesce(F.col("correct"), F.lit(False))
    usable = F.col("reject_reason").isNull()
    return shaped.agg(
        F.count_if(correct & usable).alias("processed"),
        F.count_if(~correct).alias("filtered"),
        F.count_if(correct & ~usable).alias("failed"),
        F.try_divide(F.count_if(correct & usable) * 100.0, F.count("*")).alias("success_rate"),
    )


def preprocessing_stats(examples: DataFrame) -> DataFrame:
    """Number of examples, and mean, min and max of turns and of message characters."""
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda total, m: total + F.length(m["content"]))
    return size_stats(examples.select("num_turns", chars.alias("content_length")))


def size_stats(sizes: DataFrame) -> DataFrame:
    return sizes.agg(
        F.count("*").alias("num_examples"),
        F.avg("num_turns").alias("turns_mean"),
        F.min("num_turns").cast("long").alias("turns_min"),
        F.max("num_turns").cast("long").alias("turns_max"),
        F.avg("content_length").alias("chars_mean"),
        F.min("content_length").cast("long").alias("chars_min"),
        F.max("content_length").cast("long").alias("chars_max"),
    )
