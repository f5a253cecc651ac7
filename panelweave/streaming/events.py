"""Windowed statistics of an event stream; the same function serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_events(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, mean_value; on a stream, state older than the watermark is dropped."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")
