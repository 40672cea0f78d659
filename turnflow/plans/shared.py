"""Written tables in the folder that all executors share, and joins that spread hot groups."""

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = Path(__file__).parent.parent.parent
_SHIPPED: set[tuple[str, str]] = set()


def ship_code(spark: SparkSession, *packages: str) -> SparkSession:
    """Send this package, and others that lie beside it, to the Python workers, once per application."""
    context = spark.sparkContext
    for package in ("turnflow", *packages):
        if (context.applicationId, package) not in _SHIPPED:
            target = tempfile.mkdtemp(prefix="turnflow-code-")
            context.addPyFile(shutil.make_archive(f"{target}/{package}", "zip", ROOT, package))
            _SHIPPED.add((context.applicationId, package))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="turnflow-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and return the table read back.

    It cuts the lineage and fixes the rows, so a table that several later steps read is
    neither computed twice nor ordered differently the second time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_to_groups(rows: DataFrame, groups: DataFrame, by: list[str], lots: int | None = None) -> DataFrame:
    """Join rows to the one row of `groups` that has their values of `by`, under the names `_<column>`.

    Every group is repeated for `lots` lots over which its rows are dealt, as many as the session has shuffle
    partitions if none are named, so a hot group spreads over all tasks. Nulls match nulls.
    """
    lots = lots or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_lot", F.pmod(F.monotonically_increasing_id(), F.lit(lots)))
    repeated = groups.withColumn("_in", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    same = F.col("_lot") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return dealt.join(repeated, same).drop("_lot", "_in")


def with_computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read instead of repeating its expression.

    Catalyst moves a filter below a projection by copying the projected expressions into
    it; it does not do so for a generated column.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*others, F.inline(F.array(F.struct(value.alias(name)))))
