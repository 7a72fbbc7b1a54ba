"""Aggregates with the engine's result types; each takes an optional condition (FILTER WHERE)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _if(c: Column, where: Column | None) -> Column:
    return c if where is None else F.when(where, c)


def count(c: Column | None = None, where: Column | None = None) -> Column:
    """Rows, or values of c that aren't null."""
    return F.count(_if(F.lit(1) if c is None else c, where))


def count_if(where: Column) -> Column:
    return F.count(F.when(where, F.lit(1)))


def count_distinct(c: Column, where: Column | None = None) -> Column:
    return F.countDistinct(_if(c, where))


def total(c: Column, scale: int | None = None, where: Column | None = None) -> Column:
    """The sum; null without values. scale: that of a decimal column, which then gives decimal(38, scale)."""
    s = F.sum(_if(c, where))
    return s if scale is None else s.cast(f"decimal(38,{scale})")


def avg(c: Column, where: Column | None = None) -> Column:
    """The mean as a double, of decimals too."""
    return F.avg(_if(c.cast("double"), where))


def minimum(c: Column, where: Column | None = None) -> Column:
    return F.min(_if(c, where))


def maximum(c: Column, where: Column | None = None) -> Column:
    return F.max(_if(c, where))
