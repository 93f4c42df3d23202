"""Scoring features as one projection: alias resolution, normalised values, context flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import thresholds as T

# Optional inputs: canonical column -> (accepted names in order, type).
OPTIONAL = {
    "distance_to_facility_m": (["distance_to_facility_m", "distance_to_industry"], "double"),
    "distance_to_forest_m": (["distance_to_forest_m", "distance_to_forest"], "double"),
    "distance_to_agriculture_m": (["distance_to_agriculture_m", "distance_to_agriculture"], "double"),
    "persistence_score": (["persistence_score", "persistence"], "double"),
    "facility_type": (["facility_type"], "string"),
    "inside_industrial_area": (["inside_industrial_area"], "boolean"),
    "detections_24h": (["detections_24h"], "long"), "detections_7d": (["detections_7d"], "long"),
    "detections_30d": (["detections_30d"], "long"), "hotspot_cluster_size": (["hotspot_cluster_size"], "long"),
    "ndvi": (["ndvi"], "double"), "ndbi": (["ndbi"], "double"),
    "facility_baseline": (["facility_baseline"], "double"), "current_activity": (["current_activity"], "double"),
    "activity_anomaly": (["activity_anomaly"], "double"),
}


def canonical_label(label: Column) -> Column:
    """The alias of the persistent class maps to its canonical name."""
    return F.when(label == "persistent_industrial_source", F.lit(T.PERSISTENT)).otherwise(label)


def engineer(df: DataFrame) -> DataFrame:
    """Add the scoring features; absent context stays NULL, never 0."""
    resolved = {}
    for name, (sources, kind) in OPTIONAL.items():
        found = [F.col(s).cast(kind) for s in sources if s in df.columns]
        resolved[name] = F.coalesce(*found) if found else F.lit(None).cast(kind)
    resolved["facility_type"] = F.nullif(F.lower(F.trim(resolved["facility_type"])), F.lit(""))
    out = df.withColumns(resolved)

    base, cur, given = F.col("facility_baseline"), F.col("current_activity"), F.col("activity_anomaly")
    both = base.isNotNull() & cur.isNotNull()
    ratio = F.when(both & (base > 0), cur / F.nullif(base, F.lit(0.0)))
    derived = F.when(both & (base > 0), (cur - base) / F.nullif(base, F.lit(0.0))).when(
        both, F.greatest(cur, F.lit(0.0)))
    given_ratio = F.when(given.isNotNull() & both & (base != 0), cur / F.nullif(base, F.lit(0.0)))
    out = out.withColumns({
        "frp_norm": F.least(F.col("frp") / 250.0, F.lit(1.0)),
        "bt_norm": F.greatest(F.lit(0.0), F.least((F.col("brightness_temperature") - 300) / 120.0, F.lit(1.0))),
        "anomaly_ratio": F.when(given.isNull(), ratio).otherwise(given_ratio),
        "activity_anomaly": F.coalesce(given, derived),
        "is_flare_facility": F.coalesce(F.col("facility_type").isin(T.FLARE_TYPES), F.lit(False)),
        "is_industrial_facility": F.coalesce(F.col("facility_type").isin(T.INDUSTRIAL_FACILITY_TYPES), F.lit(False))})

    def known(*names: str) -> Column:
        return F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(True)) for n in names], F.lit(False))

    return out.withColumns({
        "has_industrial_context": known("distance_to_facility_m", "facility_type"),
        "has_forest_context": known("distance_to_forest_m"),
        "has_agri_context": known("distance_to_agriculture_m"),
        "has_temporal_context": known("persistence_score", "detections_24h", "detections_7d"),
        "has_landcover_context": known("ndvi", "ndbi"),
        "has_anomaly_context": known("activity_anomaly")})
