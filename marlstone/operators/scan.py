"""Scans: what to read is declared, Spark pushes it to the files."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sorting import sort_key
from ..sources.parquet import row_group_count, row_groups, scan_size, table_of


@dataclass(frozen=True)
class ScanRequest:
    """A scan of a file or folder.

    where: a condition in SQL; order_by: keys as "column [desc] [nulls first]"; in_file_order: rows in
    the order of file names and places; groups: only these row groups.
    """

    path: str
    columns: tuple[str, ...] = ()
    where: str | None = None
    order_by: tuple[str, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False
    in_file_order: bool = False
    groups: tuple[int, ...] | None = None


def scan(spark: SparkSession, r: ScanRequest, source: DataFrame | None = None) -> DataFrame:
    df = source if source is not None else (table_of(spark, r.path) if r.groups is None else row_groups(spark, r.path, list(r.groups)))
    if r.where:
        df = df.where(r.where)
    if r.in_file_order:
        df = df.orderBy("_metadata.file_path", "_metadata.row_index")
    out = df.select(*[F.col(c) for c in r.columns]) if r.columns else df
    if r.distinct:
        out = out.distinct()
    if r.order_by:
        out = out.orderBy(*[sort_key(k) for k in r.order_by]) if r.distinct or not r.columns else df.orderBy(*[sort_key(k) for k in r.order_by]).select(*r.columns)
    if r.offset:
        out = out.offset(r.offset)
    return out if r.limit is None else out.limit(r.limit)


def filtered_by_keys(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column is among the keys: an exact runtime filter.

    A semi-join; Spark broadcasts the keys if their size is within its limit, and builds a Bloom
    filter from them for the scan if the table is large.
    """
    return df.join(keys.select(F.col(key).alias("__k")).distinct(), df[column] == F.col("__k"), "left_semi")


@dataclass(frozen=True)
class Metrics:
    rows: int
    row_groups: int
    bytes: int
    seconds: float


def scan_metrics(spark: SparkSession, r: ScanRequest) -> Metrics:
    """Rows that a scan gives, and the row groups and bytes that its columns have in the files."""
    began = time.monotonic()
    n = scan(spark, r).count()
    return Metrics(n, row_group_count(spark, r.path), scan_size(spark, r.path, list(r.columns) or None), time.monotonic() - began)
