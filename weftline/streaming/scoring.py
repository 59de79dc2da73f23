"""Structured Streaming: the panel's grid from an event stream, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_sums(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(series_id, hour, y) in append mode: an hour's sum is final when the watermark has passed it."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    sums = stamped.groupBy(F.window("at", "1 hour"), F.col("event_type").alias("series_id")).agg(F.sum("value").alias("y"))
    return sums.select("series_id", F.col("window.start").alias("hour"), "y")
