"""Windowed aggregates over event streams; late rows within the watermark count, later ones do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, lateness: str, width: str) -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value), batch or stream."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
