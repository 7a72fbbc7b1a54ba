"""Exchanges as plan steps."""

from __future__ import annotations

from pyspark.sql import DataFrame


def hash_repartition(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of equal keys together, in n partitions."""
    return df.repartition(n, *keys)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def gather(df: DataFrame) -> DataFrame:
    """One partition, for outputs that are small by their nature."""
    return df.coalesce(1)
