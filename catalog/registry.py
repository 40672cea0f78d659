"""Where every query and its SQL are registered."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnflow.plans import shared as plans

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if it has one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def ship_code(spark: SparkSession) -> SparkSession:
    """Send the library and the queries to the Python workers."""
    return plans.ship_code(spark, "catalog")
