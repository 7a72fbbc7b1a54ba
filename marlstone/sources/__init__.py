"""Parquet files and folders, their footers, and the catalog of registered tables."""

from .catalog import Catalog, Table
from .parquet import column_constant, column_max, footers, is_sorted, row_group_count, row_groups, scan_size, table_of, total_rows

__all__ = ["Catalog", "Table", "column_constant", "column_max", "footers", "is_sorted", "row_group_count", "row_groups", "scan_size", "table_of", "total_rows"]
