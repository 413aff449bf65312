"""Scalar column expressions: casts, text, dates. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"


def nan_to_null(column: Column) -> Column:
    """Float input marks missing values with NaN or null; keep only null."""
    column = column.cast("double")
    return F.when(~F.isnan(column), column)


def flag(predicate: Column, unknown: int | None = None) -> Column:
    """A predicate as 0/1; an unknown predicate becomes ``unknown``, null by default."""
    number = predicate.cast("bigint")
    return number if unknown is None else F.coalesce(number, F.lit(unknown).cast("bigint"))


def lenient_number(column: Column) -> Column:
    """Number in a string, or null if it cannot be read as one."""
    return column.try_cast("double")


def epoch_to_timestamp(seconds: Column) -> Column:
    """Whole epoch seconds as a timestamp without time zone; fractions are cut off."""
    return F.timestamp_add("SECOND", seconds.cast("bigint"), F.expr(EPOCH))


def month_start(timestamp: Column) -> Column:
    """First instant of the month, without going through the session time zone."""
    return F.trunc(F.to_date(timestamp), "MM").cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days between the calendar dates of two columns."""
    return F.datediff(F.to_date(later), F.to_date(earlier)).cast("bigint")


def short_date(column: Column) -> Column:
    """Date such as ``Oct 1, 2008``; anything else is null."""
    return F.try_to_date(column, "MMM d, yyyy")


def text_length(column: Column) -> Column:
    """Length in code points."""
    return F.char_length(column).cast("bigint")


def word_count(column: Column) -> Column:
    """Runs of non-blank characters, blanks being any Unicode white space.

    A text without such a run counts as one (empty) word, as splitting on
    single spaces would give.
    """
    runs = F.regexp_count(column, F.lit(r"(?U)\S+"))
    return F.when(column.isNotNull(), F.greatest(runs, F.lit(1))).cast("bigint")


def grouped_digits(number: Column) -> Column:
    """Whole number with thousands separators, such as ``46,743``."""
    return F.format_number(number, 0)
