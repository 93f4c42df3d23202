"""Windowed activity per grid cell; the same functions run on a stream or on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(events: DataFrame, degrees: float) -> DataFrame:
    return events.withColumns({"cell_y": F.floor(F.col("latitude") / degrees).cast("long"),
                               "cell_x": F.floor(F.col("longitude") / degrees).cast("long")})


def _activity(events: DataFrame, window, degrees: float, delay: str) -> DataFrame:
    rows = _cells(events, degrees)
    if events.isStreaming:
        rows = rows.withWatermark("ts", delay)
    out = rows.groupBy(window.alias("w"), "cell_y", "cell_x").agg(
        F.count(F.lit(1)).alias("detections"), F.sum("frp").alias("frp_sum"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cell_y", "cell_x",
                      "detections", "frp_sum")


def daily_activity(events: DataFrame, degrees: float = 0.5, delay: str = "1 day") -> DataFrame:
    """Detections and FRP per cell and day."""
    return _activity(events, F.window("ts", "1 day"), degrees, delay)


def weekly_activity(events: DataFrame, degrees: float = 0.5, delay: str = "1 day") -> DataFrame:
    """Detections and FRP per cell over 7 days, every day."""
    return _activity(events, F.window("ts", "7 days", "1 day"), degrees, delay)
