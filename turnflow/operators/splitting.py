"""Exact train / validation / test splits and their checks."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnflow.operators.checks import require_columns
from turnflow.plans.ordering import with_position, with_shuffled_position
from turnflow.plans.shared import join_to_groups, written

SPLITS = ["train", "validation", "test"]
#: Ranges of remainders that are counted at a time.
BINS = 65_536


def _part_of(total: int, share: float) -> int:
    # rounding first keeps 0.15 * 20 from falling to 2
    return math.floor(round(total * share, 6))


def _threshold(dealt: DataFrame, wanted: int, total: int) -> tuple[int, int, int, int]:
    """Places left after whole shares, the remainder at that rank from the top, how many strata lie above it, and how many have it.

    Remainders are counted in BINS ranges, then in those of the range that holds the one looked for, until a range is
    one number; at most BINS counts reach the driver at a time, and the first of them tell the places left.
    """
    low, high, above, left = 0, max(total, 1), 0, None
    while True:
        width = -(-(high - low) // BINS)
        inside = dealt.where((F.col("_rest") >= low) & (F.col("_rest") < high))
        bins = inside.groupBy(F.expr(f"(_rest - {low}L) div {width}L").alias("bin")).agg(F.count("*").alias("n"), F.sum("_whole").alias("whole"))
        counts = sorted(bins.collect(), key=lambda row: -row["bin"])
        if left is None:
            left = wanted - sum(row["whole"] for row in counts)
        if not left:
            return 0, 0, 0, 0
        for row in counts:
            if above + row["n"] >= left:
                break
            above += row["n"]
        low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width)
        if width == 1:
            return left, low, above, row["n"]


def _quota(strata: DataFrame, count: str, total: int, wanted: int, name: str) -> DataFrame:
    """Deal `wanted` places to the strata in proportion to `count`, by largest remainder, equal ones in order of names.

    The places left after whole shares go to the strata above a threshold that is searched in counted remainders. Only
    strata that have just this remainder, if not all of them get a place, are put in order, by a range partitioning.
    """
    share = F.col(count).cast("decimal(19,0)") * F.lit(wanted).cast("decimal(19,0)")
    base = F.lit(max(total, 1)).cast("decimal(19,0)")
    dealt = strata.withColumn("_rest", share % base).withColumn("_whole", ((share - F.col("_rest")) / base).cast("long"))
    dealt = dealt.withColumn("_rest", F.col("_rest").cast("long"))
    left, threshold, above, equal = _threshold(dealt, wanted, total)
    if not left:
        return dealt.withColumn(name, F.col("_whole")).drop("_rest", "_whole")
    if above + equal == left:
        return dealt.withColumn(name, F.col("_whole") + (F.col("_rest") >= threshold).cast("long")).drop("_rest", "_whole")
    ties = with_position(dealt.where(F.col("_rest") == threshold).select(F.col("stratum").alias("_tied")), ["_tied"], name="_rank")
    chosen = ties.where(F.col("_rank") < left - above).select("_tied", F.lit(1).cast("long").alias("_one"))
    more = F.when(F.col("_rest") > threshold, 1).otherwise(F.coalesce("_one", F.lit(0)))
    return dealt.join(chosen, F.col("stratum").eqNullSafe(F.col("_tied")), "left").withColumn(name, F.col("_whole") + more).drop(
        "_rest", "_whole", "_tied", "_one")


def split_quotas(strata: DataFrame, train: float, validation_of_rest: float) -> DataFrame:
    """Train and validation places of each stratum; `strata` has one row per stratum, of any number."""
    strata = written(strata, "strata")
    total = strata.agg(F.sum("n")).first()[0] or 0
    wanted = _part_of(total, train)
    first = _quota(strata, "n", total, wanted, "train_places").withColumn("_n2", F.col("n") - F.col("train_places"))
    second = _quota(first, "_n2", total - wanted, _part_of(total - wanted, validation_of_rest), "validation_places")
    return second.select("stratum", "n", "train_places", "validation_places")


def stratified_split(
    df: DataFrame,
    id_col: str,
    train: float = 0.75,
    validation: float = 0.125,
    test: float = 0.125,
    by: str | None = "task",
    seed: int = 42,
) -> DataFrame:
    """Add `split`, with exact sizes per stratum.

    Rows are taken in the order of a seeded hash of their id, by their position in it; rows
    with the same id, or none, have positions of their own, so sizes always hold. The order
    is a range partitioning over stratum and hash, so a hot stratum spreads over many tasks.
    """
    if not math.isclose(train + validation + test, 1.0):
        raise ValueError(f"split sizes must sum to 1.0, got {train + validation + test}")
    require_columns(df, [id_col] if by is None else [id_col, by])
    stratum = F.lit("all") if by is None else F.col(by).cast("string")
    keyed = df.withColumn("stratum_", stratum)
    # the rows are written in their order here, so counting the strata reads one column of them
    placed = with_shuffled_position(keyed, id_col, seed, ("stratum_",), "_place")
    rest = validation + test
    strata = placed.groupBy(F.col("stratum_").alias("stratum")).agg(F.count("*").alias("n"))
    quotas = split_quotas(strata, train, validation / rest if rest else 0.0).select(
        F.col("stratum").alias("_stratum_"), "train_places", "validation_places")
    split = (
        F.when(F.col("_place") < F.col("train_places"), "train")
        .when(F.col("_place") < F.col("train_places") + F.col("validation_places"), "validation")
        .otherwise("test")
    )
    joined = join_to_groups(placed, quotas, ["stratum_"])
    return joined.withColumn("split", split).select(*df.columns, "split")


def random_split(df: DataFrame, id_col: str, train=0.75, validation=0.125, test=0.125, seed: int = 42) -> DataFrame:
    """`stratified_split` with a single stratum."""
    return stratified_split(df, id_col, train, validation, test, by=None, seed=seed)


def split_leakage(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Number of ids and of texts that occur in more than one split, and the rows that carry them."""
    keys = F.array(
        F.struct(F.lit("id").alias("kind"), F.col(id_col).cast("string").alias("key")),
        F.struct(F.lit("text").alias("kind"), F.md5(F.col(text_col)).alias("key")),
    )
    per_key = df.select("split", F.inline(keys)).groupBy("kind", "key").agg(
        (F.min("split") != F.max("split")).alias("shared"), F.count("*").alias("n")
    )
    return per_key.groupBy("kind").agg(
        F.count_if("shared").alias("shared_keys"), F.sum(F.when(F.col("shared"), F.col("n")).otherwise(0)).alias("rows_affected")
    )


def split_statistics(df: DataFrame) -> DataFrame:
    """Per split: rows, and the spread of `num_turns` and of `formatted_text` where they exist."""
    measures = []
    if "num_turns" in df.columns:
        measures += _spread(F.col("num_turns"), "turns")
    if "formatted_text" in df.columns:
        measures += _spread(F.length("formatted_text"), "text")
    return df.groupBy("split").agg(F.count("*").alias("num_examples"), *measures)


def _spread(value: Column, name: str) -> list[Column]:
    return [
        F.avg(value).alias(f"{name}_mean"),
        F.percentile(value, F.lit(0.5)).alias(f"{name}_median"),
        F.min(value).cast("long").alias(f"{name}_min"),
        F.max(value).cast("long").alias(f"{name}_max"),
        F.stddev_pop(value).alias(f"{name}_std"),
    ]


def split_tasks(df: DataFrame) -> DataFrame:
    """Rows per split and task, and their percentage of the split."""
    counts = df.groupBy("split", "task").agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy("split"))
    return counts.select("split", "task", "n", (F.col("n") * 100.0 / size).alias("percent"))


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, share of the whole, and mean and deviation of the turns per split."""
    turns = [F.avg("num_turns").alias("turns_mean"), F.stddev_pop("num_turns").alias("turns_std")]
    stats = df.groupBy("split").agg(F.count("*").alias("n"), *(turns if "num_turns" in df.columns else []))
    # one row per split
    return stats.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))
