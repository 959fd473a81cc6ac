"""Streaming forms of the interval and attribution tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_events(events: DataFrame, time_col: str, keys: list[str], value_col: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean by key and event-time window; rows later than ``late`` are left out by the watermark.

    Works on streams and on tables.
    """
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    out = events.withWatermark(time_col, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"), F.avg(value_col).alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def sessions(events: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events closer than ``gap`` are one, with its ends and count."""
    out = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
