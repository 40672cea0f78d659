"""Exploration reports over a raw corpus and over token counts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnflow.constants import PROFILE_FIELDS
from turnflow.functions.messages import tool_names
from turnflow.plans.ordering import with_position
from turnflow.plans.ranks import quantiles
from turnflow.plans.shared import join_to_groups, written


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls and their percentage per column, in one pass."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = counts.unpivot(["_rows"], [f"`{c}`" for c in df.columns], "column_name", "nulls")
    return long.select("column_name", "nulls", F.round(F.try_divide(F.col("nulls") * 100.0, F.col("_rows")), 2).alias("percent"))


def length_stats(lengths: DataFrame, column: str) -> DataFrame:
    """Mean, median, min, max and population deviation of a length.

    The exact median holds one counter per distinct length, not one value per row.
    """
    return lengths.agg(
        F.avg(column).alias("mean"),
        F.percentile(column, F.lit(0.5)).alias("median"),
        F.min(column).cast("long").alias("min"),
        F.max(column).cast("long").alias("max"),
        F.stddev_pop(column).alias("std"),
    )


def trace_length_stats(df: DataFrame) -> DataFrame:
    """`length_stats` of the raw message count; a missing trace counts 0."""
    size = F.when(F.col("trace").isNull(), 0).otherwise(F.size("trace"))
    return length_stats(df.select(size.alias("n")), "n")


def company_table(df: DataFrame) -> DataFrame:
    """The company fields as a flat table."""
    return df.select(*[
        (F.col(f"`{source}`") if source in df.columns else F.lit(None).cast("string")).alias(name)
        for source, name in PROFILE_FIELDS.items()
    ])


def _with_percent(counts: DataFrame) -> DataFrame:
    """Add each row's share of the sum of `n`; `counts` has a row per distinct value."""
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def task_distribution(df: DataFrame) -> DataFrame:
    """Rows and their percentage per task, most common first; a missing task is "unknown"."""
    tasks = df.select(F.coalesce("task", F.lit("unknown")).alias("task"))
    counts = tasks.groupBy("task").agg(F.count("*").alias("n"))
    return _with_percent(counts).orderBy(F.desc("n"), "task")


def correctness_distribution(df: DataFrame) -> DataFrame:
    """Rows and their percentage for true and false, of the rows that are either."""
    known = df.filter(F.col("correct").isNotNull())
    return _with_percent(known.groupBy("correct").agg(F.count("*").alias("n")))


def tool_usage(df: DataFrame) -> DataFrame:
    """Calls per tool name, most used first."""
    calls = df.select(F.explode("trace").alias("m")).select(F.explode(tool_names(F.col("m.tool_calls"))).alias("tool"))
    return calls.groupBy("tool").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool")


def value_counts(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per distinct value, written once, so that a costly `column` is computed in one pass.

    Lengths and token counts have few distinct values, however many rows there are.
    """
    return written(df.groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("n")), "value-counts")


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest value, of each group if `by` is given.

    Every bin has a row with its edges `low` and `high`, empty ones too; the last bin is closed. If all
    values are equal, the bins reach half a unit to either side.
    """
    keys = () if by is None else (by,)
    counts = value_counts(df.filter(F.col(column).isNotNull()), column, keys)
    span = counts.groupBy(*keys).agg(F.min("v").cast("double").alias("_min"), F.max("v").cast("double").alias("_max"))
    flat = F.col("_min") == F.col("_max")
    span = span.where("_min is not null").select(
        *[F.col(c).alias(f"_{c}") for c in keys],
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_low"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    edges = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        *[F.col(f"_{c}").alias(c) for c in keys], "bin",
        (F.col("_low") + F.col("bin") * width).alias("low"), (F.col("_low") + (F.col("bin") + 1) * width).alias("high"))
    number = F.least(F.floor((F.col("v") - F.col("_low")) / width).cast("int"), F.lit(bins - 1))
    filled = join_to_groups(counts, span, list(keys)).groupBy(
        *[F.col(c).alias(f"_{c}") for c in keys], number.alias("_bin")).agg(F.sum("n").alias("n"))
    same = F.col("bin") == F.col("_bin")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return edges.join(filled, same, "left").select(*keys, "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def _fences(counts: DataFrame, by: str) -> DataFrame:
    """Quartiles of counted values, and the bounds 1.5 times their range beyond them."""
    spread = F.col("q2") - F.col("q0")
    return quantiles(counts, "v", "n", [0.25, 0.5, 0.75], (by,)).select(
        F.col(by).alias(f"_{by}"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
        (F.col("q0") - 1.5 * spread).alias("_low"), (F.col("q2") + 1.5 * spread).alias("_high"))


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, the extreme values within 1.5 times the quartile range, and the number beyond.

    The quartiles are picked by rank, so a group may have any number of distinct values.
    """
    counts = value_counts(df.filter(F.col(column).isNotNull()), column, (by,))
    fenced = join_to_groups(counts, _fences(counts, by), [by])
    inside = F.col("v").between(F.col("_low"), F.col("_high"))
    return fenced.groupBy(by).agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).cast("double").alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).cast("double").alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )


def box_outliers(df: DataFrame, column: str, by: str) -> DataFrame:
    """The rows beyond the whiskers of `box_stats`."""
    fences = _fences(value_counts(df.filter(F.col(column).isNotNull()), column, (by,)), by)
    rows = join_to_groups(df, fences, [by])
    return rows.filter(~F.col(column).between(F.col("_low"), F.col("_high"))).select(*df.columns)


def cumulative_share(df: DataFrame, column: str, by: str, id_col: str) -> DataFrame:
    """Percentage of rows up to each row in value order; equal values get different shares."""
    placed = with_position(df.select(by, column, id_col), [column, id_col], (by,), total="size")
    return placed.select(by, column, id_col, ((F.col("position") + 1) * 100.0 / F.col("size")).alias("share"))


def truncation_impact(df: DataFrame) -> DataFrame:
    """Rows, truncated rows and their percentage per split."""
    truncated = F.count_if("will_truncate")
    return df.groupBy("split").agg(
        F.count("*").alias("total"),
        truncated.alias("truncated"),
        (truncated * 100.0 / F.count("*")).alias("percent"),
    )


def longest_examples(df: DataFrame, limit: int, n: int = 3) -> DataFrame:
    """The `n` rows with most tokens per split, and what they exceed `limit` by.

    Spark keeps the first rows per split before the shuffle, so a large split costs no
    more than its best rows.
    """
    order = Window.partitionBy("split").orderBy(F.desc("token_count"), "original_index")
    return (
        df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        .select(
            "split", "rank", "original_index", "token_count",
            (F.col("num_messages") if "num_messages" in df.columns else F.size("messages")).alias("num_messages"),
            F.coalesce("task", F.lit("N/A")).alias("task"),
            F.greatest(F.col("token_count") - limit, F.lit(0)).alias("tokens_over_limit"),
        )
    )


def show_example(df: DataFrame, index: int | None = None) -> DataFrame:
    """Messages one per row with the role in capitals; of one example if `index` is given."""
    chosen = df if index is None else df.filter(F.col("original_index") == index)
    return chosen.select("original_index", "task", "num_turns", F.posexplode("messages").alias("position", "m")).select(
        "original_index", "task", "num_turns", "position",
        F.upper("m.role").alias("role"), F.col("m.content").alias("content"),
    )
