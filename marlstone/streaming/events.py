"""Event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 day", late: str = "2 days", value: str | None = None) -> DataFrame:
    """Events (and the sum of `value`) per window and group; a stream drops what is later than `late`."""
    events = events.withColumn("__t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("__t", late)
    sums = [F.round(F.sum(value), 2).alias("total")] if value else []
    out = events.groupBy(F.window("__t", width).alias("w"), *by).agg(F.count("*").alias("n"), *sums)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "n", *[s for s in (["total"] if value else [])])
