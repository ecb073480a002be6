"""Hourly counters as a stream: watermarked windows, the streaming form of the ``hourly_rolling`` query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """``hour, event_type, queries`` per tumbling hour; events later than ``late`` are left out once an hour is final."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("queries"))
    return counted.select(F.col("window.start").alias("hour"), "event_type", "queries")


def last_day(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Queries of the last 24 hours, told every hour."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "1 hour")).agg(F.count(F.lit(1)).alias("used_24h"))
    return counted.select(F.col("window.end").alias("at"), "used_24h")
