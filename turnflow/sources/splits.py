"""Splits on disk: one folder per named split, or one table partitioned by split."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from turnflow.operators.splitting import SPLITS, split_statistics, split_tasks
from turnflow.sources.paths import path_exists
from turnflow.sources.reports import write_stats

#: Folders beside the splits: one row per split, and one per split and task.
STATISTICS, TASKS = "_split_statistics", "_split_tasks"


def write_split(df: DataFrame, path: str, name: str) -> str:
    """Save one split under `path/name`."""
    target = f"{path}/{name}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Load one split; a missing one is FileNotFoundError, any other failure OSError."""
    target = f"{path}/{name}"
    if not path_exists(spark, target):
        raise FileNotFoundError(f"split not found: {target}")
    try:
        return spark.read.parquet(target)
    except AnalysisException as error:
        raise OSError(f"failed to load split {target}: {error}") from error


def write_splits(df: DataFrame, path: str, save_stats: bool = True) -> None:
    """Save all splits as one table partitioned by `split`, with their statistics and those of their tasks, of any number."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    if save_stats:
        saved = df.sparkSession.read.parquet(path)
        write_stats(split_statistics(saved), f"{path}/{STATISTICS}")
        if "task" in df.columns:
            write_stats(split_tasks(saved), f"{path}/{TASKS}")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Load the splits there are; no folder is FileNotFoundError, no split in it OSError."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"splits directory not found: {path}")
    if not any(path_exists(spark, f"{path}/split={name}") for name in SPLITS):
        raise OSError(f"no splits found in {path}")
    try:
        return spark.read.parquet(path).filter(F.col("split").isin(SPLITS))
    except AnalysisException as error:
        raise OSError(f"failed to load splits from {path}: {error}") from error
