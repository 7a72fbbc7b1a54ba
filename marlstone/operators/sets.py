"""Set operations by position; nulls equal each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..functions.sorting import sort_key


def union(*parts: DataFrame, all: bool = False) -> DataFrame:
    out = reduce(DataFrame.union, parts)
    return out if all else out.distinct()


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Rows of both; with all, as often as in the one that has fewer."""
    return a.intersectAll(b) if all else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    """Rows of a that aren't in b; with all, each as often as a has more."""
    return a.exceptAll(b) if all else a.subtract(b)


def top_of_union(parts: list[DataFrame], order: list[str], n: int) -> DataFrame:
    """The first n rows of UNION ALL: each part is cut to its first n before."""
    keys = [sort_key(k) for k in order]
    return reduce(DataFrame.union, [p.orderBy(*keys).limit(n) for p in parts]).orderBy(*keys).limit(n)
