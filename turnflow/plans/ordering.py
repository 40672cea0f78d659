"""Positions in a total order, without sorting any group in a single task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnflow.plans.shared import written

# monotonically_increasing_id holds the partition above these bits, the row below them.
ROW_BITS = 33


def numbered_once(df: DataFrame) -> DataFrame:
    """`df` written as it lies, with `_row`, which grows along every partition, and `_part`."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "ordered")
    return rows.withColumn("_part", F.shiftright("_row", ROW_BITS))


def with_position(
    df: DataFrame, order: list[str], by: tuple[str, ...] = (), name: str = "position", total: str | None = None
) -> DataFrame:
    """Add the 0-based position of each row in `order`, counted within `by` if given.

    Rows are range-partitioned over all keys, so one hot group spreads over many tasks, as
    do rows that `order` does not tell apart; these get different positions. What is
    joined is one row per partition and group, by both. Nulls come first. `total` names a
    column for the number of rows of the group.
    """
    keys = [*by, *order, "_tie"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.withColumn("_tie", F.rand(7)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return _from_offsets(numbered_once(ordered.drop("_tie")), by, name, total)


def _from_offsets(rows: DataFrame, by: tuple[str, ...], name: str, total: str | None) -> DataFrame:
    """Positions from the place in the partition and the rows of the group in earlier partitions."""
    group = Window.partitionBy(*[f"_{c}" for c in by])
    earlier = group.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy(F.col("_part").alias("_of"), *[F.col(c).alias(f"_{c}") for c in by]).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n")
    ).withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_total": F.sum("_n").over(group)})
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = rows.join(stretches, same).withColumn(name, F.col("_before") + F.col("_row") - F.col("_first"))
    if total is not None:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_row", "_part", "_of", "_first", "_n", "_before", "_total", *[f"_{c}" for c in by])


def shuffle_key(seed: int, id_col: str) -> Column:
    """Reproducible pseudo-random sort key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def with_shuffled_position(
    df: DataFrame, id_col: str, seed: int, by: tuple[str, ...] = (), name: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row in the order of `shuffle_key` within `by`."""
    keyed = df.withColumn("_key", shuffle_key(seed, id_col))
    return with_position(keyed, ["_key", id_col], by, name).drop("_key")
