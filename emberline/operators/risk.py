"""Risk score 0-100, level and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import thresholds as T
from emberline.operators.classify import _bands, _total

# Points per class.
CLASS_POINTS = {T.INDUSTRIAL_FIRE: 4, T.PERSISTENT: 2, T.GAS_FLARE: 1, T.WILDFIRE: 3, T.AGRICULTURAL: -4, T.UNKNOWN: -6}


def _frp_points(frp: Column) -> Column:
    """Piecewise linear: (from MW, points there, points gained up to the next band)."""
    edges = [(T.FRP_HIGH, T.FRP_VERY_HIGH, 18, 7), (T.FRP_MEDIUM, T.FRP_HIGH, 10, 8), (T.FRP_LOW, T.FRP_MEDIUM, 4, 6)]
    out = F.when(frp >= T.FRP_VERY_HIGH, F.lit(25.0))
    for low, top, start, gain in edges:
        out = out.when(frp >= low, F.lit(float(start)) + (frp - low) / float(top - low) * gain)
    return out.otherwise(frp / float(T.FRP_LOW) * 4)


def risk_score(df: DataFrame) -> DataFrame:
    """Add ``risk_score`` (int) and ``risk_level`` to an engineered and classified frame."""
    dist, kind, pers = F.col("distance_to_facility_m"), F.col("facility_type"), F.col("persistence_score")
    industrial = F.col("is_industrial_facility")
    inside = F.coalesce("inside_industrial_area", F.lit(False))
    anomaly, cls, size = F.col("activity_anomaly"), F.col("classification"), F.col("hotspot_cluster_size")
    bt = F.col("brightness_temperature")
    calm = anomaly.isNull() | (anomaly < 0.5)
    thermal = _total(_frp_points(F.col("frp")),
                     _bands((bt >= T.BT_VERY_HIGH, 5), (bt >= T.BT_HIGH, 3), (bt >= T.BT_LOW, 1)),
                     F.col("confidence") / 100.0 * 5)
    # Sums run left to right through named columns: ties at .5 depend on the order of addition.
    out = df.withColumn("_points", thermal)
    out = out.withColumn("_points", _total(
        F.col("_points"),
        _bands((dist < 200, 20), (dist < 500, 16), (dist < 2000, 10), (dist < 5000, 4), (dist.isNotNull(), 1),
               (industrial, 8), (inside, 6)),
        _bands((kind.isin(T.CRITICAL_TYPES), 5), (industrial, 2)), _bands((inside, 3))))
    out = out.withColumn("_points", _total(
        F.col("_points"),
        F.when(pers.isNotNull(), pers * 15).otherwise(
            F.coalesce(F.least(F.col("detections_7d") / 14.0 * 10, F.lit(10.0)), F.lit(0.0))),
        _bands((pers.isNull() & (F.col("detections_24h") >= 3), 3)),
        _bands((size >= 5, 5), (size >= 3, 2)),
        _bands((anomaly >= 5, 20), (anomaly >= 2, 14), (anomaly >= 1, 10), (anomaly >= 0.5, 6), (anomaly >= 0, 2)),
        _bands(((F.col("ndvi") < 0.2) & (F.col("ndbi") > 0.3), 2))))
    points = _total(
        F.col("_points"), _bands(*[(cls == c, p) for c, p in CLASS_POINTS.items()]),
        _bands(((cls == T.GAS_FLARE) & calm & (F.col("frp") < 50), -8)),
        _bands(((cls == T.PERSISTENT) & calm, -5)))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), points))
    out = out.withColumn("risk_score", F.rint(clamped).cast("int")).drop("_points")
    return out.withColumn("risk_level", risk_level(F.col("risk_score")))


def risk_level(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 30, "MODERATE").otherwise("LOW")


def triage(df: DataFrame) -> DataFrame:
    """Add recommended_tier, triage_required and action."""
    score = F.col("risk_score")
    first = score >= T.TIER1_RISK
    return df.withColumns({
        "triage_required": first, "recommended_tier": F.when(first, F.lit(1)),
        "action": F.when(first, "tier1_alert").when(score >= T.MONITOR_RISK, "monitoring").otherwise("store_only")})
