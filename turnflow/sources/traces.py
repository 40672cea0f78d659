"""Reading the raw corpus."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from turnflow.schemas import TRACE
from turnflow.sources.paths import path_exists


def read_traces(spark: SparkSession, path: str, cache: str | None = None) -> DataFrame:
    """Raw examples from Parquet or JSON lines; the first read fills `cache`, later ones use it."""
    try:
        # a folder without the mark of a finished write is a write that was cut off
        if cache and path_exists(spark, f"{cache}/_SUCCESS"):
            return spark.read.schema(TRACE).parquet(cache)
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
        reader = spark.read.schema(TRACE)
        raw = reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)
        if not cache:
            return raw
        raw.write.mode("overwrite").parquet(cache)
        return spark.read.schema(TRACE).parquet(cache)
    except (AnalysisException, OSError) as error:
        raise ValueError(f"failed to load traces from {path}: {error}") from error


def table_profile(df: DataFrame) -> DataFrame:
    """Row count and column names; `first_keys` only where the table has a row."""
    names = F.lit(",".join(df.columns))
    rows = F.count("*")
    return df.agg(
        rows.alias("num_examples"),
        names.alias("features"),
        F.when(rows > 0, names).alias("first_keys"),
    )
