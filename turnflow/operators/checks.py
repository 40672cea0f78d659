"""Early checks on a table's shape."""

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Return `df`, or raise a ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}; found: {', '.join(df.columns)}")
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Return `df`, or raise a ValueError if it has no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df
