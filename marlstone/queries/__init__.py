"""Named queries, each with the same question as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import frames, inventory, tpch


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**tpch.QUERIES, **inventory.QUERIES, **frames.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**tpch.ORACLE, **inventory.ORACLE, **frames.ORACLE}
