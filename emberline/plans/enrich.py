"""Composed enrichment jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.timefeat import daynight, time_features
from emberline.operators import clean, enrichment, polygons, proximity

# Columns the job adds, in the published order.
ENRICHED = [
    "persistence", "persistence_score", "detections_24h", "detections_7d", "detections_30d", "hotspot_cluster_size",
    "facility_baseline", "facility_current_activity", "facility_anomaly", "current_activity", "activity_anomaly",
    "nearest_facility_distance_m", "distance_to_industry", "distance_to_facility_m", "nearest_facility_type", "facility_type",
    "nearest_facility_osm_id", "nearest_facility_id", "nearest_facility_name", "facility_count_500m", "facility_count_1km",
    "industrial_facility_count_500m", "industrial_facility_count_1km", "power_facility_count_1km", "oil_gas_facility_count_1km",
    "nearest_powerplant_distance_m", "nearest_refinery_distance_m", "nearest_oil_gas_distance_m",
    "nearest_steel_facility_distance_m", "nearest_cement_facility_distance_m", "landcover_class", "distance_to_forest",
    "distance_to_forest_m", "distance_to_agriculture", "distance_to_agriculture_m", "forest_fraction", "agriculture_fraction",
    "industrial_fraction", "builtup_fraction", "water_fraction", "bare_fraction", "hour_utc", "day_of_week", "month", "daynight"]


def flagship(events: DataFrame, facilities: DataFrame, k: int) -> DataFrame:
    """Earlier detections nearby, persistence score and nearest facility within 5 km; the top k by score."""
    inside = clean.bbox_filter(events, 6.0, 68.0, 37.5, 97.5)
    scored = enrichment.persistence(inside, events).withColumn("persistence_score", F.round("persistence_score", 6))
    # The dimension join runs on the k winners only; it cannot change their order.
    top = scored.orderBy(F.desc("persistence_score"), "event_id").limit(k)
    return proximity.nearest_within(top, facilities)


def enrich(events: DataFrame, facilities: DataFrame, landcover: DataFrame | None = None,
           landcover_edges: DataFrame | None = None, daynight_lookup: DataFrame | None = None,
           history: DataFrame | None = None) -> DataFrame:
    """Facility, land-cover, temporal and time context for every event: original columns first, then ``ENRICHED``.

    One row in, one row out.  Missing datasets give NULL (land cover: unknown),
    counts are 0.
    """
    out = enrichment.temporal_context(events, history)
    out = proximity.nearest(out, facilities)
    counts = [c for c in proximity.FACILITY_COUNTS if c[0] != "facility_count_5km"] + proximity.CATEGORY_COUNTS
    out = proximity.radius_counts(out, facilities, counts)
    out = proximity.nearest_by_category(out, facilities, proximity.CATEGORIES)
    if landcover is not None and landcover_edges is not None:
        out = polygons.landcover_of(out, landcover, landcover_edges)
        out = polygons.distance_to_classes(out, landcover, landcover_edges,
                                           {"distance_to_forest_m": "forest", "distance_to_agriculture_m": "agriculture"})
    else:
        none = F.lit(None).cast("double")
        out = out.withColumns({"landcover_class": F.lit("unknown"), "distance_to_forest_m": none,
                               "distance_to_agriculture_m": none})
    out = daynight(time_features(out), daynight_lookup)
    none = F.lit(None).cast("double")
    return out.withColumns({
        "persistence": F.col("persistence_score"), "facility_current_activity": F.col("current_activity"),
        "facility_anomaly": F.col("activity_anomaly"), "nearest_facility_distance_m": F.col("distance_to_facility_m"),
        "distance_to_industry": F.col("distance_to_facility_m"), "nearest_facility_type": F.col("facility_type"),
        "nearest_facility_osm_id": F.col("nearest_facility_id"), "distance_to_forest": F.col("distance_to_forest_m"),
        "distance_to_agriculture": F.col("distance_to_agriculture_m"),
        **{f"{k}_fraction": none for k in ("forest", "agriculture", "industrial", "builtup", "water", "bare")},
    }).select(*[c for c in events.columns if c not in ENRICHED], *ENRICHED)


def enrich_with_infrastructure(events: DataFrame, infrastructure: DataFrame) -> DataFrame:
    """Typed-layer context within 5 km: nearest overall and per type with presence flags, counts per radius and type."""
    out = proximity.nearest_within(events, infrastructure)
    out = proximity.nearest_by_type(out, infrastructure, proximity.INFRASTRUCTURE_TYPES)
    return proximity.radius_counts(out, infrastructure, proximity.FACILITY_COUNTS + proximity.INFRASTRUCTURE_COUNTS)
