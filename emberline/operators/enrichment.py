"""Temporal context and cell counts of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.timefeat import activity_anomaly, persistence_score
from emberline.operators.neighbours import NearCount, near_counts
from emberline.operators.proximity import LAT, LON
from emberline.operators.timeline import past, span_counts

PERSISTENCE = [NearCount("detections_24h", 500.0, 1), NearCount("detections_7d", 500.0, 7),
               NearCount("detections_30d", 500.0, 30)]
CLUSTER = NearCount("_cluster", 1000.0)
BASELINE = [NearCount("_prior", 1000.0), NearCount("_week", 1000.0, 7)]


def _baseline_columns(df: DataFrame, total: str, week: str, days: int = 30) -> DataFrame:
    base, cur = F.col(total) / float(days), F.col(week) / 7.0
    anomaly, ratio = activity_anomaly(base, cur)
    return df.withColumns({"facility_baseline": base, "current_activity": cur, "activity_anomaly": anomaly,
                           "anomaly_ratio": ratio})


def persistence(events: DataFrame, history: DataFrame | None = None, symmetric: bool = False) -> DataFrame:
    """Detections within 500 m in 24 h / 7 d / 30 d, and the persistence score."""
    out = near_counts(events, events if history is None else history, PERSISTENCE, symmetric)
    return out.withColumn("persistence_score", persistence_score(F.col("detections_24h"), F.col("detections_7d")))


def hotspot_cluster_size(events: DataFrame, history: DataFrame | None = None, symmetric: bool = False) -> DataFrame:
    """Detections within 1 km (earlier ones only unless symmetric) plus the event itself."""
    out = near_counts(events, events if history is None else history, [CLUSTER], symmetric)
    return out.withColumn("hotspot_cluster_size", F.col("_cluster") + 1).drop("_cluster")


def activity_baseline(events: DataFrame, history: DataFrame, lat: str = LAT, lon: str = LON,
                      same: str | None = None) -> DataFrame:
    """Baseline (all earlier / 30) and current activity (last 7 days / 7) within 1 km of a location.

    With ``same``, history counts only where it has the event's value in that column.
    """
    out = near_counts(events, history, BASELINE, lat=lat, lon=lon, same=same)
    return _baseline_columns(out, "_prior", "_week").drop("_prior", "_week")


def temporal_context(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Persistence, cluster size and baseline from one pass over the neighbours (past only)."""
    out = near_counts(events, events if history is None else history, [*PERSISTENCE, *BASELINE])
    out = out.withColumn("persistence_score", persistence_score(F.col("detections_24h"), F.col("detections_7d")))
    out = out.withColumn("hotspot_cluster_size", F.col("_prior") + 1)
    return _baseline_columns(out, "_prior", "_week").drop("_prior", "_week", "anomaly_ratio")


def trailing_counts(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Earlier rows of the same exact key within 24 h / 7 d / 30 d (window edge inclusive, strictly earlier)."""
    keyed = events.withColumn("at", F.unix_micros(ts))
    series = keyed.groupBy(key, "at").agg(F.count(F.lit(1)).alias("n"))
    spans = [past("trailing_24h", 1), past("trailing_7d", 7), past("trailing_30d", 30)]
    counts = span_counts(series, series.select(key, "at"), [key], spans)
    return keyed.join(counts, [key, "at"], "left").drop("at")


def cell_counts(events: DataFrame) -> DataFrame:
    """Add lat_grid, lon_grid (0.01 degree, half to even) and spatial_persistence_count, on every row.

    A combining aggregate plus join instead of a window, so a hot cell is never
    buffered in one task.
    """
    out = events.withColumns({"lat_grid": F.rint(F.col(LAT) * 100) / 100, "lon_grid": F.rint(F.col(LON) * 100) / 100})
    counts = out.groupBy("lat_grid", "lon_grid").agg(F.count(F.lit(1)).alias("spatial_persistence_count"))
    return out.join(counts, ["lat_grid", "lon_grid"], "left")
