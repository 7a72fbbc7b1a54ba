"""Window functions with nulls last and the engine's result types."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.sorting import sort_key

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}
SUMS = {"sum": F.sum, "avg": F.avg, "count": F.count}


def spec(partition: list[str] = (), order: list[str] = ()) -> WindowSpec:
    w = Window.partitionBy(*partition)
    return w.orderBy(*[sort_key(k) for k in order]) if order else w


def rank_by(kind: str, partition: list[str], order: list[str]) -> Column:
    """row_number, rank or dense_rank as bigint."""
    return RANKS[kind]().over(spec(partition, order)).cast("bigint")


def lag(c: str | Column, n: int, partition: list[str], order: list[str]) -> Column:
    return F.lag(c, n).over(spec(partition, order))


def lead(c: str | Column, n: int, partition: list[str], order: list[str]) -> Column:
    return F.lead(c, n).over(spec(partition, order))


def whole(kind: str, c: Column, partition: list[str] = ()) -> Column:
    """sum, avg (doubles) or count (bigint) over the whole partition."""
    v = SUMS[kind](c).over(spec(partition))
    return v if kind == "count" else v.cast("double")


def running(kind: str, c: Column, partition: list[str], order: list[str], by_row: bool = False) -> Column:
    """The same up to the current row; rows of equal order count together unless by_row."""
    w = spec(partition, order)
    w = w.rowsBetween(Window.unboundedPreceding, 0) if by_row else w.rangeBetween(Window.unboundedPreceding, 0)
    v = SUMS[kind](c).over(w)
    return v if kind == "count" else v.cast("double")
