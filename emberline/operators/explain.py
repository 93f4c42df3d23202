"""Evidence sentences: an array of guarded templates, first six kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import thresholds as T


def _say(template: str, *values: Column) -> Column:
    return F.format_string(template, *values) if values else F.lit(template)


def _metres(c: Column) -> Column:
    """Whole number, half to even, as text."""
    return F.rint(c).cast("long").cast("string")


def explain(df: DataFrame) -> DataFrame:
    """Add ``explanation`` to an engineered, classified frame: ordered, distinct, at most six sentences."""
    frp, bt, dist = F.col("frp"), F.col("brightness_temperature"), F.col("distance_to_facility_m")
    kind, cls, pers = F.col("facility_type"), F.col("classification"), F.col("persistence_score")
    industrial, flare = F.col("is_industrial_facility"), F.col("is_flare_facility")
    anomaly, ratio = F.col("activity_anomaly"), F.col("anomaly_ratio")
    d24, d7, size = F.col("detections_24h"), F.col("detections_7d"), F.col("hotspot_cluster_size")
    ndvi, ndbi = F.col("ndvi"), F.col("ndbi")
    forest, agri = F.col("distance_to_forest_m"), F.col("distance_to_agriculture_m")
    use_ratio = F.coalesce(F.nullif(ratio, F.lit(0.0)), anomaly + 1)

    intensity = (F.when(frp >= T.FRP_VERY_HIGH, _say("Very high thermal intensity (FRP %.1f MW)", frp))
                 .when(frp >= T.FRP_HIGH, _say("High thermal intensity (FRP %.1f MW)", frp))
                 .when(frp >= T.FRP_MEDIUM, _say("Elevated thermal intensity (FRP %.1f MW)", frp))
                 .when(frp < 10, _say("Low thermal intensity (FRP %.1f MW)", frp)))
    hot = F.when(bt >= T.BT_HIGH, _say("High brightness temperature (%s K)", _metres(bt)))
    place = (F.when(dist < 100, _say("Thermal anomaly is %sm from an industrial facility — very close proximity", _metres(dist)))
             .when(dist < T.INDUSTRIAL_CLOSE_M, _say("Thermal anomaly is %sm from an industrial facility", _metres(dist)))
             .when(dist < T.INDUSTRIAL_NEAR_M, _say("Industrial facility within %sm", _metres(dist)))
             .when(dist > T.INDUSTRIAL_FAR_M, _say("No industrial facility within %.1f km", dist / 1000))
             .when(dist.isNull() & industrial, _say("Associated with %s facility type", kind)))
    inside = F.when(F.col("inside_industrial_area"), _say("Event is inside a mapped industrial area"))
    match = (F.when(flare & (cls == T.GAS_FLARE), _say("Facility type '%s' is associated with gas flaring", kind))
             .when(industrial & cls.isin(T.INDUSTRIAL_FIRE, T.PERSISTENT),
                   _say("Nearby facility type '%s' matches industrial thermal activity", kind)))
    steady = (F.when(pers >= T.PERSISTENCE_HIGH, _say("Thermal activity has persisted across multiple detections (high persistence)"))
              .when(pers >= T.PERSISTENCE_MODERATE, _say("Persistent thermal activity detected over recent days"))
              .when(pers < T.PERSISTENCE_LOW, _say("Isolated/temporary thermal detection — low persistence")))
    week = F.when((d7 >= 10) & pers.isNull(), _say("%d detections in last 7 days indicate persistent activity", d7))
    day = F.when(d24 >= 4, _say("%d detections in last 24h", d24))
    spike = (F.when((anomaly >= 5) & (ratio != 0), _say("Current activity is %.1fx the facility baseline — highly anomalous", ratio))
             .when(anomaly >= 5, _say("Activity is %s%% above baseline — highly anomalous", _metres(anomaly * 100)))
             .when(anomaly >= 1, _say("Activity exceeds historical facility baseline by %s%% (%.1fx)",
                                      _metres(anomaly * 100), use_ratio))
             .when(anomaly >= 0.5, _say("Activity is %s%% above facility baseline", _metres(anomaly * 100)))
             .when(anomaly < 0, _say("Activity is below historical baseline")))
    green = (F.when(ndvi > T.NDVI_VEGETATION, _say("High vegetation context (NDVI %.2f)", ndvi))
             .when(ndvi < T.NDVI_LOW, _say("Low vegetation / built-up context (NDVI %.2f)", ndvi)))
    built = (F.when(ndbi > T.NDBI_BUILTUP, _say("Built-up / industrial land signature (NDBI %.2f)", ndbi))
             .when(ndbi < 0, _say("Vegetated / non-built-up land (NDBI %.2f)", ndbi)))
    woods = F.when(forest < T.FOREST_CLOSE_M, _say("Close to forest/vegetated area (%sm)", _metres(forest)))
    farms = F.when(agri < T.AGRI_CLOSE_M, _say("Agricultural land nearby (%sm)", _metres(agri)))
    cluster = (F.when(size >= 5, _say("Clustered thermal anomalies — %d hotspots in vicinity suggests spreading fire", size))
               .when(size >= 3, _say("Multiple hotspots detected (cluster size %d)", size)))
    unsure = F.when(F.col("class_confidence") < 0.6, _say("Low model confidence — limited contextual evidence available"))

    lines = F.array_compact(F.array(intensity, hot, place, inside, match, steady, week, day, spike, green, built,
                                    woods, farms, cluster, unsure))
    nothing = F.array(F.when(cls == T.UNKNOWN, _say("Insufficient contextual information to determine thermal source type"))
                      .otherwise(_say("Classification based on thermal and spatial features (FRP %.1f, confidence %s)",
                                      frp, _metres(F.col("confidence")))))
    out = df.withColumn("_lines", lines)
    return out.withColumn("explanation", F.slice(F.array_distinct(
        F.when(F.size("_lines") == 0, nothing).otherwise(F.col("_lines"))), 1, 6)).drop("_lines")


def explain_tracker(df: DataFrame) -> DataFrame:
    """Add ``tracker_reasons`` over tracker features; no filler line when evidence is thin."""
    frp, plant, flare = F.col("frp"), F.col("distance_to_plant_km"), F.col("distance_to_flare_km")
    contrast, steady = F.col("temp_diff_ti4_ti5"), F.col("map_persistence")
    power = (F.when(frp >= 50, _say("Elevated Fire Radiative Power (%.1f MW) indicating intense thermal emission.", frp))
             .when(frp >= 10, _say("Moderate thermal radiative intensity (%.1f MW).", frp))
             .when(frp < 10, _say("Low radiative power (%.1f MW) near background surface baseline.", frp)))
    return df.withColumn("tracker_reasons", F.array_compact(F.array(
        power,
        F.when(plant <= 3.0, _say("Proximity to industrial facility '%s' (%.2f km away).", F.col("nearest_plant_name"), plant)),
        F.when(flare <= 2.0, _say("Active hydrocarbon flaring zone '%s' (%.2f km away).", F.col("nearest_flare_field"), flare)),
        F.when(contrast >= 20.0, _say("High thermal contrast between VIIRS I4 & I5 channels (ΔT = %.1f K).", contrast)),
        F.when(steady >= 60, _say("High spatial persistence score (%s%%) over 7-day observation window.", steady.cast("string"))))))
