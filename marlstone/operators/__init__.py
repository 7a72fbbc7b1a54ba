"""Operators on DataFrames: scans, joins, aggregation, windows, set operations, exchanges, sinks."""

from .aggregate import aggregate, group_distribution
from .exchange import gather, hash_repartition, round_robin
from .joins import JoinRequest, anti_join, join, semi_join
from .scan import Metrics, ScanRequest, filtered_by_keys, scan, scan_metrics
from .sets import except_, intersect, top_of_union, union
from .sinks import ParquetOptions, print_rows, write_csv, write_parquet
from .windows import lag, lead, rank_by, running, whole

__all__ = [
    "JoinRequest", "Metrics", "ParquetOptions", "ScanRequest", "aggregate", "anti_join", "except_", "filtered_by_keys", "gather", "group_distribution", "hash_repartition", "intersect", "join",
    "lag", "lead", "print_rows", "rank_by", "round_robin", "running", "scan", "scan_metrics", "semi_join", "top_of_union", "union", "whole", "write_csv", "write_parquet",
]
