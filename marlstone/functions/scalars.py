"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*cols: Column) -> Column:
    """The texts joined; null ones count as empty, so the result is never null."""
    return F.concat_ws("", *cols)


def substring(s: Column, start: Column | int, n: Column | int | None = None) -> Column:
    """From the start-th character (a start below 1 is the first), n characters or all the rest."""
    start = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    rest = F.length(s) if n is None else (F.lit(n) if isinstance(n, int) else n)
    return F.substring(s, start, rest)


def trim_unicode(s: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(s, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")


def length(s: Column) -> Column:
    return F.length(s).cast("bigint")


def list_at(items: Column, i: Column | int) -> Column:
    """The i-th element, from 1; null if there is none."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.get(items, (i - 1).cast("int"))


def list_length(items: Column) -> Column:
    return F.size(items).cast("bigint")


def add(a: Column, b: Column) -> Column:
    """a + b, null beyond the type's range."""
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def int_div(a: Column, b: Column) -> Column:
    """The whole part of a / b; null if b is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))


def divide_exact(a: Column, b: Column) -> Column:
    """Decimal division as doubles; null if b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def decimal_product(a: Column, b: Column, precision: int, scale: int) -> Column:
    """a * b with the type's scale kept exact."""
    return (a * b).cast(f"decimal({max(18, min(38, precision))},{scale})")


def absolute(a: Column) -> Column:
    return F.abs(a.cast("double"))


def round_half_up(a: Column) -> Column:
    """To a whole double, halves away from zero."""
    return F.round(a.cast("double"))


def floor(a: Column) -> Column:
    return F.floor(a.cast("double")).cast("double")


def ceil(a: Column) -> Column:
    return F.ceil(a.cast("double")).cast("double")


def year_of(d: Column) -> Column:
    return F.year(d).cast("bigint")


def date_number(d: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(d).cast("bigint")
