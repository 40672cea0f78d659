"""Reading training-metric logs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.schemas import METRIC_LOG

POINT = ["run_id", "tag", "step"]


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Points of all runs from Parquet or CSV, in step order per run and tag.

    Of a point that is logged several times the value written last counts: that of the file written last, of files
    of the same time the last by name, and in a file the last row. So every read gives the same.
    """
    reader = spark.read.schema(METRIC_LOG)
    csv = path.rstrip("/").endswith(".csv")
    raw = reader.csv(path, header=True) if csv else reader.parquet(path)
    # a text file tells no row numbers, but where its parts begin; within a part ids grow row by row
    place = ["_metadata.file_block_start", F.monotonically_increasing_id()] if csv else ["_metadata.row_index"]
    return sorted_points(raw, F.struct("_metadata.file_modification_time", "_metadata.file_path", *place))


def sorted_points(log: DataFrame, written: Column | None = None) -> DataFrame:
    """Points sorted by run, tag and step, each once.

    Of equal points the one `written` last counts, by that order; without one, the greatest value. A null value is one
    like any other in that order, and gives way to every other without it.
    """
    if written is None:
        once = log.groupBy(*POINT).agg(F.max("value").alias("value"))
    else:
        last = log.select(*POINT, F.struct(written.alias("written"), "value").alias("_of")).groupBy(*POINT).agg(F.max("_of").alias("_of"))
        once = last.select(*POINT, F.col("_of.value").alias("value"))
    return once.orderBy(*POINT)
