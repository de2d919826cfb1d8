"""The dialect's value semantics as Columns: errors become NULL, sums stay exact, text functions know ASCII only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_add(a: Column, b: Column) -> Column:
    """BIGINT sum, NULL on overflow."""
    return F.try_add(a.cast("bigint"), b.cast("bigint"))


def safe_subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a.cast("bigint"), b.cast("bigint"))


def safe_multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a.cast("bigint"), b.cast("bigint"))


def safe_divide(a: Column, b: Column) -> Column:
    """Always DOUBLE, NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def safe_abs(x: Column) -> Column:
    return F.when(x < 0, F.try_subtract(F.lit(0).cast("bigint"), x.cast("bigint"))).otherwise(x.cast("bigint"))


def money_multiply(a: Column, b: Column) -> Column:
    """DECIMAL(18,2) product, digits beyond two cut towards zero, NULL on overflow."""
    v = a.cast("decimal(18,2)") * b.cast("decimal(18,2)")
    return F.when(v < 0, F.ceil(v, F.lit(2))).otherwise(F.floor(v, F.lit(2))).try_cast("decimal(18,2)")


def money_add(a: Column, b: Column) -> Column:
    return (a.cast("decimal(18,2)") + b.cast("decimal(18,2)")).try_cast("decimal(18,2)")


def money_of(x: Column) -> Column:
    """DOUBLE to DECIMAL(18,2) by rounding a hundred times the value, halves away from zero."""
    return (F.round(x * 100.0).try_cast("bigint").cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)")).try_cast("decimal(18,2)")


def whole_of(s: Column) -> Column:
    """Text to BIGINT without trimming."""
    return F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("bigint"))


def strict_date(s: Column) -> Column:
    """YYYY-MM-DD of the calendar, else NULL."""
    return F.when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s.try_cast("date"))


def strict_timestamp(s: Column) -> Column:
    """A date, or date and time with T or blank, fraction cut and Z allowed; else NULL."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z?)?$"
    return F.when(s.rlike(shape), F.date_trunc("second", F.regexp_replace(s, r"(\.[0-9]+)?Z?$", "").try_cast("timestamp")))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def ascii_upper(s: Column) -> Column:
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From 1; a start below 1 counts as 1 and does not shorten, a negative length is 0."""
    at = F.greatest(start, F.lit(1)).cast("int")
    return F.substring(s, at, F.greatest(length, F.lit(0)).cast("int") if length is not None else F.char_length(s))


def like(s: Column, pattern: str) -> Column:
    """% and _ without an escape character."""
    return s.like(pattern.replace("\\", "\\\\"))


def date_plus_seconds(d: Column, seconds: Column) -> Column:
    """DATE plus an interval: NULL unless it is whole days."""
    return F.when(seconds % 86400 == 0, F.date_add(d, (seconds / 86400).cast("int")))
