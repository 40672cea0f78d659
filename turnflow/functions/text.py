"""Column functions for cleaning, formatting and cutting text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnflow.constants import (
    NOT_WHITESPACE, OUTER_WHITESPACE, REPEATED_PUNCTUATION, SCORE, THINK_BLOCK, WHITESPACE_RUN,
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, OUTER_WHITESPACE, "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(F.rlike(text, F.lit(NOT_WHITESPACE)), F.lit(False))


def clean_text(text: Column) -> Column:
    """Single spaces, no outer white space, and one mark per run of sentence marks."""
    spaced = F.trim(F.regexp_replace(text, WHITESPACE_RUN, " "))
    return F.regexp_replace(spaced, REPEATED_PUNCTUATION, "$1")


def with_clean_text(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the cleaned form of a text column; any other column type is a TypeError."""
    found = df.schema[column].dataType
    if not isinstance(found, T.StringType):
        raise TypeError(f"expected a string column, {column} is {found.simpleString()}")
    return df.withColumn(name, clean_text(F.col(column)))


def format_integer(value: Column, currency: bool = False) -> Column:
    """Null as N/A, currency with grouping, other numbers grouped only above 1000."""
    grouped = F.format_number(value, 0)
    if currency:
        shown = F.concat(F.lit("$"), grouped)
    else:
        shown = F.when(value > 1000, grouped).otherwise(value.cast("string"))
    return F.coalesce(shown, F.lit("N/A"))


def format_string(value: Column) -> Column:
    return F.coalesce(value, F.lit("N/A"))


def trim_at_stop(text: Column, stops: list[str]) -> Column:
    """Text before the earliest stop string, stripped."""
    if not stops:
        return strip(text)
    found = F.array(*[F.instr(text, stop) for stop in stops])
    first = F.array_min(F.filter(found, lambda at: at > 0))
    return strip(F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1)))


def strip_think(text: Column) -> Column:
    """Text without its <think>...</think> blocks."""
    return F.regexp_replace(text, THINK_BLOCK, "")


def parse_score(text: Column) -> Column:
    """First score digit in a judge's answer; null when missing or above 5."""
    digit = F.try_to_number(F.regexp_extract(text, SCORE, 1), F.lit("9")).cast("int")
    return F.when(digit <= 5, digit)
