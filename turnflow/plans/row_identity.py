"""Numbers of rows as they lie in a table, without moving or sorting them.

The Parquet reader knows for every row its file and its place there. With the rows of the files before, one
number per file, the position of a row is an expression on the scan: nothing is exchanged but these numbers,
later filters still reach the reader, and a lost task reads the same numbers again.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnflow.plans.shared import written

#: Files whose first positions are broadcast, about 200 bytes each; those of more files are joined as Spark sees fit.
BROADCAST_FILES = 200_000


def _natural(path: str) -> list:
    """Sort key of a path in which numbers count as numbers, so part-100000 follows part-99999."""
    return [(0, int(piece), "") if piece.isdigit() else (1, 0, piece) for piece in re.split(r"(\d+)", path)]


def is_scan(df: DataFrame) -> bool:
    """Whether `df` is a Parquet table as read, or made of one by projections, so that it has every row of its files once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.toString().rstrip().endswith("parquet")


def _identified(scan: DataFrame) -> DataFrame:
    """A scan with `_file` and `_at`, the file of a row and its place there."""
    return scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))


def _first_positions(rows: DataFrame) -> dict[str, int]:
    """Of every file the position of its first row, files in order of their paths.

    One row per file comes to the driver, which holds the list of files anyway; no column is read.
    """
    first, total = {}, 0
    for f in sorted(rows.groupBy("_file").count().collect(), key=lambda f: _natural(f["_file"])):
        first[f["_file"]] = total
        total += f["count"]
    return first


def with_scan_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Add the 0-based position of each row in the order in which the table lies in its files.

    `df` is a table as read from Parquet, or projections of it. Anything else (another source, a table that a
    filter, a join or a union changed) has no such order and is written once to the shared folder, in the order of
    its partitions. Rows with equal or null columns have positions of their own; an empty table gives none.
    """
    rows = _identified(df if is_scan(df) else written(df, "as-it-lies"))
    first = _first_positions(rows)
    if len(first) <= 1:
        return rows.withColumn(name, F.col("_at")).drop("_file", "_at")
    offsets = df.sparkSession.createDataFrame(list(first.items()), "_of string, _before long")
    if len(first) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    placed = rows.join(offsets, F.col("_file") == F.col("_of"))
    return placed.withColumn(name, F.col("_before") + F.col("_at")).drop("_file", "_at", "_of", "_before")
