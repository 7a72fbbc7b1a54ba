"""Equi-joins. Spark chooses the algorithm by size; a request can ask for one."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds by the names that requests use.
KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
HINTS = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}


@dataclass(frozen=True)
class JoinRequest:
    """A join of two inputs on pairs of keys.

    The outputs are named by the prefixes ("l." gives "l.key"); left_columns and right_columns choose
    them. residual: a further condition on the joined row. algorithm: hash, merge, or none for
    Spark's choice; memory_limit: a build side beyond so many bytes isn't broadcast.
    """

    keys: tuple[tuple[str, str], ...]
    kind: str = "inner"
    left_prefix: str = ""
    right_prefix: str = ""
    left_columns: tuple[str, ...] | None = None
    right_columns: tuple[str, ...] | None = None
    left_where: str | None = None
    right_where: str | None = None
    residual: str | None = None
    algorithm: str | None = None
    memory_limit: int | None = None


def join(left: DataFrame, right: DataFrame, r: JoinRequest) -> DataFrame:
    if r.left_where:
        left = left.where(r.left_where)
    if r.right_where:
        right = right.where(r.right_where)
    if r.memory_limit is not None and r.algorithm is None and right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > r.memory_limit:
        right = right.hint("merge")
    if r.algorithm:
        right = right.hint(HINTS[r.algorithm])
    left = left.select(*[F.col(f"`{c}`").alias(r.left_prefix + c) for c in left.columns])
    right = right.select(*[F.col(f"`{c}`").alias(r.right_prefix + c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[f"`{r.left_prefix}{a}`"] == right[f"`{r.right_prefix}{b}`"] for a, b in r.keys])
    if r.residual:
        cond = cond & F.expr(r.residual)
    out = left.join(right, cond, KINDS[r.kind])
    cols = [left[f"`{r.left_prefix}{c}`"] for c in r.left_columns] if r.left_columns is not None else [left[f"`{c}`"] for c in left.columns]
    if r.kind not in ("semi", "anti"):
        cols += [right[f"`{r.right_prefix}{c}`"] for c in r.right_columns] if r.right_columns is not None else [right[f"`{c}`"] for c in right.columns]
    return out.select(*cols)


def semi_join(left: DataFrame, right: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """Left rows with a partner."""
    return join(left, right, JoinRequest(keys, "semi"))


def anti_join(left: DataFrame, right: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """Left rows without one; a null key has none."""
    return join(left, right, JoinRequest(keys, "anti"))
