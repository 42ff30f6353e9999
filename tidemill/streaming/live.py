"""Operators over Structured Streaming readings ``series_id, t, v, recv_ms``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(points: DataFrame, lateness: str) -> DataFrame:
    clean = points.where(F.col("v").isNotNull() & ~F.isnan("v") & F.col("t").isNotNull() & F.col("series_id").isNotNull())
    return clean.withColumn("at", F.timestamp_millis("t")).withWatermark("at", lateness)


def latest_reading_stream(points: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drops repeated readings of one series and time within the watermark; the first to arrive stays."""
    return _timed(points, lateness).dropDuplicatesWithinWatermark(["series_id", "t"]).drop("at")


def downsample_stream(points: DataFrame, period_ms: int, aggregation: str = "avg", lateness: str = "1 hour") -> DataFrame:
    """One value per series and slot of the period from epoch 0, given out once the watermark has passed the slot.

    State is one partial aggregate per open slot. Readings later than ``lateness`` behind the latest are left out.
    """
    how = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[aggregation]
    slots = _timed(points, lateness).groupBy("series_id", F.window("at", f"{period_ms} milliseconds"))
    return slots.agg(how("v").alias("v"), F.count("v").alias("n")).select(
        "series_id", F.unix_millis("window.start").alias("t"), "v", "n"
    )
