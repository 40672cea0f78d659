"""Logits and labels by sequence and position, stored so that sequences are read without an exchange."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnflow.plans.shared import shared_folder


def write_logits(df: DataFrame, table: str | None = None, buckets: int | None = None, path: str | None = None) -> str:
    """Save (`seq`, `pos`, `logits`, `label`) as a table bucketed by sequence and sorted by position; returns its name.

    A bucket is one file, written by one task. `buckets`, the session's shuffle partitions if not given, has to grow with
    the table; `path` is a folder that all executors share, one of its own in the shared folder if not given.
    """
    spark = df.sparkSession
    name = table or f"logits_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartition(buckets, "seq").write.bucketBy(buckets, "seq").sortBy("seq", "pos").mode("overwrite")
        .option("path", path or f"{shared_folder(spark)}/{name}").saveAsTable(name)
    )
    return name


def read_logits(spark: SparkSession, table: str) -> DataFrame:
    """A table of `write_logits`; windows and groups by `seq` keep its rows where they are."""
    return spark.table(table)
