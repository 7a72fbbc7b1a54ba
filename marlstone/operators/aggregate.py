"""Grouped and global aggregation from short texts or columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions import aggregates as A

FUNCTIONS = {"count": A.count, "sum": A.total, "avg": A.avg, "min": A.minimum, "max": A.maximum}


def parse(text: str) -> Column:
    """"sum(x) [filter (where c)] [as name]", "count(*)", "count(distinct x)"; named by its text if by nothing."""
    m = re.fullmatch(r"\s*((\w+)\s*\((.*?)\)(?:\s*filter\s*\(\s*where\s+(.*)\))?)(?:\s+as\s+(\w+))?\s*", text, re.I | re.S)
    if not m or m[2].lower() not in FUNCTIONS:
        raise ParseError(f"no aggregate: {text!r}")
    f, arg, where = m[2].lower(), m[3].strip(), F.expr(m[4]) if m[4] else None
    if d := re.fullmatch(r"distinct\s+(.+)", arg, re.I | re.S):
        if f != "count":
            raise ParseError(f"only count can be of distinct values: {text!r}")
        out = A.count_distinct(F.expr(d[1]), where)
    elif arg == "*":
        if f != "count":
            raise ParseError(f"only count can be of rows: {text!r}")
        out = A.count(where=where)
    else:
        out = FUNCTIONS[f](F.expr(arg), where=where)
    return out.alias(m[5] or m[1].lower())


def aggregate(df: DataFrame, aggregates: list[str | Column], by: list[str | Column] = (), where: str | None = None, having: str | None = None) -> DataFrame:
    """One row per group, or one in all without `by`."""
    if where:
        df = df.where(where)
    cols = [parse(a) if isinstance(a, str) else a for a in aggregates]
    out = df.groupBy(*[F.expr(b) if isinstance(b, str) else b for b in by]).agg(*cols) if by else df.agg(*cols)
    return out.where(having) if having else out


def group_distribution(df: DataFrame, key: str, size: str = "size", groups: str = "groups") -> DataFrame:
    """How many groups have each size."""
    return df.groupBy(key).agg(F.count("*").alias(size)).groupBy(size).agg(F.count("*").alias(groups))
