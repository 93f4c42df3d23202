"""Weak labels and rule-based classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import thresholds as T

# Rule table: (class, rule name, SQL predicate).  Users may pass their own rows.
# Thresholds of rule set v1; classes in declared order.
RULES_V1: list[tuple[str, str, str]] = [
    (T.PERSISTENT, "detections_7d>=5", "detections_7d >= 5"),
    (T.PERSISTENT, "persistence>=0.6", "coalesce(persistence, 0) >= 0.6"),
    (T.PERSISTENT, "hotspot_cluster_size>=5", "coalesce(hotspot_cluster_size, 0) >= 5"),
    (T.PERSISTENT, "distinct_dates>=3", "distinct_dates >= 3"),
    (T.PERSISTENT, "span_days>=5", "span_days >= 5"),
    (T.PERSISTENT, "frp_moderate", "frp between 1.0 and 15.0"),
    (T.PERSISTENT, "bt_moderate", "brightness_temperature between 310 and 350"),
    (T.INDUSTRIAL_FIRE, "frp_high", "frp >= 7.0"),
    (T.INDUSTRIAL_FIRE, "bt_high", "brightness_temperature >= 330"),
    (T.INDUSTRIAL_FIRE, "detections_24h>=2", "detections_24h >= 2"),
    (T.INDUSTRIAL_FIRE, "hotspot_cluster_size_3_15", "coalesce(hotspot_cluster_size, 0) between 3 and 15"),
    (T.INDUSTRIAL_FIRE, "anomaly_high", "coalesce(nullif(facility_anomaly, 0), activity_anomaly, 0) > 1.0"),
    (T.INDUSTRIAL_FIRE, "persistence_mid", "coalesce(persistence, 0) between 0.3 and 0.8"),
    (T.GAS_FLARE, "persistence_very_high", "coalesce(persistence, 0) >= 0.7"),
    (T.GAS_FLARE, "detections_30d>=10", "detections_30d >= 10"),
    (T.GAS_FLARE, "hotspot_small", "coalesce(hotspot_cluster_size, 0) between 1 and 5"),
    (T.GAS_FLARE, "distinct_dates>=5", "distinct_dates >= 5"),
    (T.GAS_FLARE, "span_days>=10", "span_days >= 10"),
    (T.GAS_FLARE, "frp_moderate", "frp between 3.0 and 15.0"),
    (T.GAS_FLARE, "bt_moderate", "brightness_temperature between 320 and 350"),
    (T.WILDFIRE, "hotspot_large", "coalesce(hotspot_cluster_size, 0) > 10"),
    (T.WILDFIRE, "frp_high", "frp >= 10"),
    (T.WILDFIRE, "bt_high", "brightness_temperature >= 340"),
    (T.WILDFIRE, "persistence_mid_low", "coalesce(persistence, 0) between 0.2 and 0.6"),
    (T.WILDFIRE, "distinct_dates_short", "distinct_dates between 1 and 2"),
    (T.WILDFIRE, "burst_ratio", "detections_7d > 0 and detections_30d > 0 and detections_7d / greatest(1, detections_30d) > 0.5"),
    (T.AGRICULTURAL, "persistence_low", "coalesce(persistence, 0) < 0.3"),
    (T.AGRICULTURAL, "span_short", "span_days <= 2"),
    (T.AGRICULTURAL, "distinct_dates_short", "distinct_dates <= 2"),
    (T.AGRICULTURAL, "detections_7d_low", "detections_7d <= 3"),
    (T.AGRICULTURAL, "frp_low_moderate", "frp between 0.5 and 7.0"),
    (T.AGRICULTURAL, "hotspot_small", "coalesce(hotspot_cluster_size, 0) between 1 and 3"),
    (T.AGRICULTURAL, "bt_moderate", "brightness_temperature between 300 and 340"),
]


def weak_label(df: DataFrame, rules: list[tuple[str, str, str]] = RULES_V1, version: str = "weak_rule_v1") -> DataFrame:
    """Add weak_label, label_confidence, label_source, label_reasons, confidence_level and label_scores.

    Score of a class = satisfied rules / rules.  A class qualifies with at least
    3 rules at half or more, or 4 at 0.4 or more; the best score wins, the first
    declared class on ties; otherwise ``unknown`` with half the best score.
    Missing columns count as unsatisfied, except the cluster helpers, which fall
    back to estimates from the 7-day count.
    """
    work = df
    for name in ("facility_anomaly", "activity_anomaly", "persistence"):
        if name not in work.columns:
            work = work.withColumn(name, F.lit(None).cast("double"))
    if "distinct_dates" not in work.columns:
        estimate = F.least(F.floor(F.col("detections_7d") / 2) + 1, F.lit(7))
        work = work.withColumn("distinct_dates", F.coalesce(estimate, F.lit(1)))
    if "span_days" not in work.columns:
        work = work.withColumn("span_days", F.col("distinct_dates") * 2)

    classes = list(dict.fromkeys(c for c, _, _ in rules))
    hits, scores, qualified = {}, {}, {}
    for i, cls in enumerate(classes):
        own = [(n, F.coalesce(F.expr(sql), F.lit(False))) for c, n, sql in rules if c == cls]
        hits[f"_r{i}"] = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in own]))
        count, total = F.size(f"_r{i}"), len(own)
        scores[f"_s{i}"] = count / F.lit(float(total))
        score = F.col(f"_s{i}")
        qualified[f"_q{i}"] = F.when(((count >= 3) & (score >= 0.5)) | ((count >= 4) & (score >= 0.4)), score)
    work = work.withColumns(hits).withColumns(scores).withColumns(qualified)
    best = F.greatest(F.lit(None).cast("double"), *qualified.keys())
    top = F.greatest(F.lit(0.0), *scores.keys())
    label = reasons = F
    for i, cls in enumerate(classes):
        wins = F.col(f"_q{i}") == best
        label, reasons = label.when(wins, F.lit(cls)), reasons.when(wins, F.col(f"_r{i}"))
    return work.select(
        *df.columns,
        label.otherwise(F.lit(T.UNKNOWN)).alias("weak_label"),
        F.bround(F.coalesce(best, top * 0.5), 3).alias("label_confidence"),
        F.lit(version).alias("label_source"),
        reasons.otherwise(F.array(F.lit("insufficient_evidence"))).alias("label_reasons"),
        F.when(best >= 0.7, "high").when(best >= 0.5, "medium").otherwise("low").alias("confidence_level"),
        F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.bround(f"_s{i}", 3))]).alias("label_scores"))


def _normal_background() -> Column:
    return ((F.col("frp") < 3.0) & (F.col("temp_diff_ti4_ti5") < 20.0) & (F.col("is_night") == 0)
            & (F.col("min_distance_to_industrial_km") > 3.0))


def evidence_label(df: DataFrame) -> DataFrame:
    """Add weak_supervision_label (ordered evidence) and is_industrial_candidate (1 / 0 / -1)."""
    frp, contrast, night = F.col("frp"), F.col("temp_diff_ti4_ti5"), F.col("is_night")
    flare = (F.col("distance_to_flare_km") <= 1.5) & (
        (contrast >= 20.0) | (night == 1) | (F.col("spatial_persistence_count") >= 2))
    label = (F.when(_normal_background(), "NORMAL_OR_BACKGROUND_HEAT")
             .when(flare, "PERSISTENT_FLARE_HOTSPOT")
             .when((F.col("distance_to_plant_km") <= 2.0) & (frp >= 3.0), "INDUSTRIAL_FACILITY_ALERT")
             .when((F.col("distance_to_coal_mine_km") <= 3.5) & (frp >= 3.0), "COAL_MINE_THERMAL_SOURCE")
             .when((F.col("min_distance_to_industrial_km") >= 15.0) & ((frp >= 3.0) | (contrast >= 25.0)),
                   "ACTIVE_WILDFIRE_OR_FOREST_FIRE")
             .otherwise("UNCONFIRMED_INTERMEDIATE"))
    out = df.withColumn("weak_supervision_label", label)
    name = F.col("weak_supervision_label")
    target = (F.when(name.isin("PERSISTENT_FLARE_HOTSPOT", "INDUSTRIAL_FACILITY_ALERT", "COAL_MINE_THERMAL_SOURCE"), 1)
              .when(name.isin("NORMAL_OR_BACKGROUND_HEAT", "ACTIVE_WILDFIRE_OR_FOREST_FIRE"), 0).otherwise(-1))
    return out.withColumn("is_industrial_candidate", target)


def detailed_class(df: DataFrame, industrial: str = "is_industrial") -> DataFrame:
    """Add detailed_predicted_class: background, wildfire, else the nearest of flare, plant (with fuel) and mine."""
    flare, plant, mine = (F.col(c) for c in ("distance_to_flare_km", "distance_to_plant_km", "distance_to_coal_mine_km"))
    nearest = F.least(flare, plant, mine)
    fuel = F.coalesce("nearest_plant_fuel", F.lit("Plant"))
    return df.withColumn("detailed_predicted_class", (
        F.when(_normal_background(), "Normal Background / Non-Fire Solar Heating")
        .when(~F.col(industrial), "Active Wildfire / Forest Fire")
        .when(nearest == flare, "Gas Flare / Upstream Thermal Source")
        .when(nearest == plant, F.concat(F.lit("Industrial Facility Alert ("), fuel, F.lit(")")))
        .otherwise("Coal Mine Thermal Alert")))


def fallback_class(df: DataFrame) -> DataFrame:
    """Three-way rules for events without a model: class, confidence, risk score and level."""
    dist = F.coalesce("distance_to_facility_m", F.lit(10000.0))
    fire = (dist < 500) & (F.coalesce("frp", F.lit(10.0)) > 80)
    steady = (dist < 300) & (F.coalesce("persistence_score", F.lit(0.0)) > 0.7)
    return df.withColumns({
        "classification": F.when(fire, T.INDUSTRIAL_FIRE).when(steady, "persistent_industrial_source").otherwise(T.WILDFIRE),
        "class_confidence": F.when(fire, 0.942).when(steady, 0.918).otherwise(0.880),
        "risk_score": F.when(fire, 88.0).when(steady, 65.0).otherwise(55.0),
        "risk_level": F.when(fire, "critical").otherwise("high")})


def map_record(df: DataFrame) -> DataFrame:
    """Map-side record: fire type from the class text, score, level, persistence and sensor confidence."""
    text = F.coalesce("detailed_predicted_class", "weak_supervision_label")

    def has(*words: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        return hit

    kind = (F.when(has("Flare"), "Gas Flare").when(has("Wildfire", "Forest"), "Wildfire/Natural Fire")
            .when(has("Industrial", "Plant", "Coal"), "Industrial Fire").when(has("Normal", "Background"), "Unknown")
            .when(text.isNull(), F.lit(None)).otherwise("Industrial Fire"))
    prob = F.col("prob_industrial")
    score = F.when(prob >= 0.5, F.floor(prob * 90 + 0.5)).when(prob < 0.5, F.lit(35)).cast("int")
    out = df.withColumns({"fire_type": kind, "map_risk": score})
    return out.withColumns({
        "map_risk_level": F.when(F.col("map_risk") >= 80, "critical").when(F.col("map_risk") >= 60, "high")
        .when(F.col("map_risk").isNotNull(), "moderate"),
        "map_persistence": F.least(F.col("spatial_persistence_count") * 15, F.lit(95)).cast("int"),
        "sensor_confidence": F.when(F.col("confidence") == "high", 95).when(F.col("confidence") == "nominal", 80)
        .when(F.col("confidence").isNotNull(), 65)})


def map_layer(text: Column) -> Column:
    """Map layer of a class text."""
    low = F.lower(text)
    return (F.when(low.contains("flare"), "flares")
            .when(low.contains("wildfire") | low.contains("natural") | low.contains("forest"), "wildfires")
            .when(low.contains("normal") | low.contains("background"), "normal").otherwise("industrial"))
