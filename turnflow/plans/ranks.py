"""Exact quantiles by rank: values are range-partitioned, and only the rows at the wanted ranks are picked."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnflow.plans.ordering import numbered_once


def quantiles(counts: DataFrame, value: str, n: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group with `by`, `n` (the group's rows) and `q0`, `q1`, ... for the `shares`, linearly interpolated.

    `counts` has every distinct value of a group once, with the number of its rows. Values of a hot group spread over
    many partitions, and no task holds a list of values: within a partition of the order counts are summed up, one
    row per partition and group carries the sums on, and of the rest at most two rows per group and share remain. Null
    values are left out, null groups are a group, and a group without values has no row.
    """
    keys = [*by, value]
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = counts.select(*by, F.col(value).cast("double").alias(value), F.col(n).cast("long").alias("_n")).where(F.col(value).isNotNull())
    rows = numbered_once(known.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    group = Window.partitionBy(*[f"_{c}" for c in by])
    earlier = group.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy(F.col("_part").alias("_of"), *[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("_n").alias("_sum"))
    carried = stretches.withColumns({"_before": F.coalesce(F.sum("_sum").over(earlier), F.lit(0)), "_total": F.sum("_sum").over(group)})
    so_far = Window.partitionBy("_part", *by).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_upto", F.sum("_n").over(so_far))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    last = F.col("_before") + F.col("_upto")  # rows up to this value, those of the value included
    rank = [F.lit(float(share)) * (F.col("_total") - 1) for share in shares]
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), edge.cast("long").alias("rank"), weight.alias("weight"))
        for i, r in enumerate(rank) for edge, weight in ((F.floor(r), 1 - (r - F.floor(r))), (F.floor(r) + 1, r - F.floor(r)))
    ])
    mine = F.filter(wanted, lambda w: (w["weight"] > 0) & (w["rank"] >= last - F.col("_n")) & (w["rank"] < last))
    picked = summed.join(carried, same).select(*by, value, "_total", F.explode(mine).alias("w"))
    return picked.groupBy(*by).agg(
        F.max("_total").alias("n"),
        *[F.sum(F.when(F.col("w.i") == i, F.col(value) * F.col("w.weight"))).alias(f"q{i}") for i in range(len(shares))])
