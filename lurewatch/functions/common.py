"""Small Column helpers shared by the feature families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extract_where(test: Column, text: Column, pattern: str, group: int = 0) -> Column:
    """All matches; the test may be false only where there are none, and saves the search there."""
    return F.when(~test, F.array().cast("array<string>")).otherwise(extract_all(text, pattern, group))


def only_ascii(text: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(text) == F.length(text)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def kept_length(text: Column, dropped_run: str) -> Column:
    """Number of characters left once every run of `dropped_run` is removed (cheaper than one match per character)."""
    return F.length(F.regexp_replace(text, dropped_run, ""))


def count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.array_remove(F.split(text, r"\s+"), "")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def sql_string(text: str) -> str:
    """A SQL string literal (backslashes and quotes escaped)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> Column:
    """A constant array of strings."""
    return F.expr("array(" + ", ".join(sql_string(v) for v in values) + ")")


def member(c: Column, values) -> Column:
    """c is one of a fixed list."""
    return F.array_contains(strings(values), c)


def fence(df: DataFrame, column: str) -> DataFrame:
    """Keep later filters and projections from inlining the expression behind `column`.

    Catalyst pushes a filter (also the IS NOT NULL an inner join implies) through projections by copying expressions.
    Over the long feature chain that copies whole regex families. A projection with a row id test is left in place; the
    value itself never changes.
    """
    return df.withColumn(column, F.when(F.monotonically_increasing_id() >= 0, F.col(column)))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def string_map(pairs) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_string(k)}, {sql_string(v)}" for k, v in pairs) + ")")
