"""Ranks within groups of any size: a group's rows are cut by ranges of their order, and each range is ranked by itself."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .windows import RANKS

#: Rows of a range, about, and how many of them are looked at to find where ranges end.
RANGE_ROWS, LOOKED_AT = 1 << 19, 64
#: What a query's rows may come from, for two passes over them to see the same rows.
SAME_AGAIN = {"Project", "Filter", "Join", "Union", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias", "View"}


def repeatable(df: DataFrame) -> bool:
    """Whether the rows are the same each time: no limits, ties, random values or sums of doubles in what makes them."""
    plan = df._jdf.queryExecution().optimizedPlan()
    left, same = [plan], plan.deterministic() and "subquery" not in plan.toString()
    while left and same:
        p = left.pop()
        same = p.getClass().getSimpleName() in SAME_AGAIN
        left += [p.children().apply(i) for i in range(p.children().size())]
    return same


def ascending(c: Column, kind: T.DataType, down: bool, nulls_first: bool) -> list[Column] | None:
    """Two columns without nulls whose ascending order is the one asked for, values equal there being equal here."""
    if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType)):
        v = F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c) if isinstance(kind, T.TimestampType) else c
        v, none = v.cast("bigint"), F.lit(0).cast("bigint")
        v = F.bitwise_not(v) if down else v
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        v, none = c.cast("double"), F.lit(0.0)
        v = F.when(~F.isnan(v), (F.negative(v) if down else v) + 0.0)
    elif isinstance(kind, T.DecimalType):
        v, none = F.negative(c) if down else c, F.lit(0).cast(kind)
        v = v.cast(kind)
    elif kind == T.StringType() or isinstance(kind, T.BinaryType):
        v, none = F.hex(c), F.lit("")
        v = F.concat(F.translate(v, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")) if down else v
    else:
        return None
    place = F.when(c.isNull(), 0 if nulls_first else 3)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        place = place.when(F.isnan(c), 1 if down else 2)
    return [place.otherwise(2 if down else 1), F.coalesce(v, none)]


def sorting(order: list[tuple[str, bool, bool]]) -> list[Column]:
    return [getattr(F.col(c), ("desc" if down else "asc") + ("_nulls_first" if first else "_nulls_last"))() for c, down, first in order]


def ranks_here(df: DataFrame, ranks: dict[str, str], by: list[str], order: list[tuple[str, bool, bool]]) -> DataFrame:
    """The same with a task for each group."""
    return df.withColumns({c: RANKS[kind]().over(Window.partitionBy(*by).orderBy(*sorting(order))).cast("bigint") for c, kind in ranks.items()}) if ranks else df


def literal(key, kind: T.StructType) -> str:
    return "named_struct(" + ", ".join(f"'{f.name}', CAST('{v}' AS {f.dataType.simpleString()})" for f, v in zip(kind, key, strict=True)) + ")"


def rank_by_ranges(df: DataFrame, rows: int, ranks: dict[str, str], by: list[str], order: list[tuple[str, bool, bool]]) -> DataFrame | None:
    """df with its columns `ranks` (column: kind) filled; none if its groups are small enough for a task each.

    order: (column, descending, nulls first). A bounded sample of the order's values tells where ranges
    end; a row's range follows from its values alone, so the result doesn't depend on the sample. A rank
    is the one within the range and what the group's ranges before it hold.
    """
    n = -(-rows // RANGE_ROWS)
    fields = [ascending(F.col(c), df.schema[c].dataType, down, first) for c, down, first in order]
    if n < 2 or None in fields:
        return None
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    key = F.struct(*[f.alias(f"f{i}") for i, f in enumerate(sum(fields, []))])
    keyed = df.select("*", group.alias("__g"), key.alias("__k")).drop(*ranks, *by)
    some = keyed.select("__k", F.xxhash64("__g").alias("h")).where(F.rand(7) < LOOKED_AT * n / rows).repartition(1).sortWithinPartitions("__k").collect()
    if not some or max(Counter(r.h for r in some).values()) * rows <= RANGE_ROWS * len(some):
        return None
    ends = list(dict.fromkeys(some[k * len(some) // n]["__k"] for k in range(1, n)))
    bounds = F.expr(f"array({', '.join(literal(e, keyed.schema['__k'].dataType) for e in ends)})")
    # the number of bounds that a row has reached, by halving: one comparison a step
    keyed = keyed.withColumn("__r", F.lit(0))
    for step in [1 << k for k in reversed(range(len(ends).bit_length()))]:
        keyed = keyed.withColumn("__r", F.col("__r") + F.when(F.col("__k") >= F.get(bounds, F.col("__r") + (step - 1)), step).otherwise(0))
    dense = "dense_rank" in ranks.values()
    counts = keyed.groupBy("__g", "__r").agg(F.count("*").alias("n"), (F.count_distinct("__k") if dense else F.lit(0)).alias("d"))
    before = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__g").alias("__h"), F.col("__r").alias("__q"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in "nd"])
    here = Window.partitionBy("__g", "__r").orderBy(*sorting(order))
    parts = max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    near = keyed.drop("__k").repartition(parts, "__g", "__r").select("*", *[RANKS[kind]().over(here).alias(c) for c, kind in ranks.items()])
    out = near.join(starts, (near["__g"] == starts["__h"]) & (near["__r"] == starts["__q"]))
    own = {c: (F.col(c) + F.col("__d" if kind == "dense_rank" else "__n")).cast("bigint").alias(c) for c, kind in ranks.items()}
    return out.select(*[own.get(c, F.col(f"__g.{c}").alias(c) if c in by else F.col(c)) for c in df.columns])
