"""Connected components of a link table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnflow.llm.common import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: those above a node (large), or the node and those below it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else links
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = near.join(least, "a")
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link, root being the smallest node it reaches, itself included.

    `links` has the columns a and b, both 64-bit and not null; order, repeats and loops do not matter. Every
    round is written to the shared folder, so a lost executor repeats one round at most; only two numbers
    per round reach the driver.
    """
    now = written(_ordered(links).where(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = written(_stars(_ordered(_stars(now, large=True)), large=False), "links")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
