"""Telemetry as a stream: windowed counts with a watermark for late shots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shots_per_window(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean value per event type and time window; the same on a batch."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")
