"""Joined views that the service shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_lookup(df: DataFrame, lookup: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Left join on an id whose lookup side may repeat: the last row in ``order`` wins."""
    last = lookup.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_l"))
    return df.join(last.select(key, *[F.col(f"_l.{c}").alias(c) for c in columns]), key, "left")


def attach_features(train: DataFrame, features: DataFrame, key: str, columns: list[str], flags: list[str]) -> DataFrame:
    """Left join of a feature set by id; absent columns become NULL, flags NULL -> 0, rows are kept one to one.

    Of a repeated id the smallest values count, whatever the order of the rows.
    """
    have = [c for c in [*columns, *flags] if c in features.columns]
    one = features.groupBy(key).agg(F.min(F.struct(*have)).alias("_f"))
    out = train.join(one, key, "left")
    picked = {c: F.col(f"_f.{c}") if c in have else F.lit(None).cast("double") for c in [*columns, *flags]}
    picked.update({c: F.coalesce(picked[c].cast("int"), F.lit(0)) for c in flags})
    return out.withColumns(picked).drop("_f")


def event_summary(events: DataFrame, predictions: DataFrame, facilities: DataFrame) -> DataFrame:
    """Event with its prediction and facility; defaults for the unscored, names from the event as fallback."""
    pred = predictions.select("event_id", "classification", F.col("confidence").alias("_confidence"), "risk_score", "risk_level")
    fac = facilities.select("facility_id", F.col("name").alias("_name"), F.col("facility_type").alias("_type"))
    out = events.join(pred, "event_id", "left").join(fac, "facility_id", "left")
    return out.select(
        "event_id", "latitude", "longitude", "frp", "brightness_temperature", "ts", "satellite", "facility_id",
        F.coalesce("classification", F.lit("unknown")).alias("classification"),
        F.coalesce("_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("risk_score", F.lit(0)).alias("risk_score"), F.coalesce("risk_level", F.lit("low")).alias("risk_level"),
        F.coalesce("_name", "nearest_facility_name").alias("facility_name"),
        F.coalesce("_type", "facility_type").alias("facility_type"))


def filter_events(summary: DataFrame, classification: str | None = None, risk_level: str | None = None,
                  facility_id: str | None = None, search: str | None = None) -> DataFrame:
    """Case-insensitive class and risk filters, exact facility, free text over id and facility name."""
    out = summary
    if classification:
        out = out.filter(F.lower("classification") == classification.lower())
    if risk_level:
        out = out.filter(F.lower("risk_level") == risk_level.lower())
    if facility_id:
        out = out.filter(F.col("facility_id") == facility_id)
    if search:
        text = F.concat_ws(" ", F.col("event_id").cast("string"), "facility_name")
        out = out.filter(F.lower(text).contains(search.lower()))
    return out


def category_filter(df: DataFrame, category: str) -> DataFrame:
    """Substring of either class text, ignoring case."""
    low = category.lower()
    return df.filter(F.lower("detailed_predicted_class").contains(low) | F.lower("weak_supervision_label").contains(low))


def priority_view(predictions: DataFrame, k: int) -> DataFrame:
    """The first k of the priority list: flagged or risk of at least 50, highest risk first."""
    flagged = F.col("risk_score") >= 50
    if "is_priority" in predictions.columns:
        flagged = flagged | F.coalesce("is_priority", F.lit(False))
    return predictions.filter(flagged).orderBy(F.desc("risk_score"), "event_id").limit(k)


def event_detail(events: DataFrame, predictions: DataFrame, facilities: DataFrame) -> DataFrame:
    """One nested record per event; the explanation arrives as JSON text, 0 or absent day counts read as 1."""
    pred = predictions.select("event_id", F.struct(
        "classification", "confidence", "risk_score", "risk_level",
        F.coalesce(F.from_json("explanation", "array<string>"), F.array("explanation")).alias("explanation")).alias("_p"))
    fac = facilities.select("facility_id", F.struct(F.col("facility_id").alias("id"), "name",
                                                    F.col("facility_type").alias("type")).alias("_f"))
    out = events.join(pred, "event_id", "left").join(fac, "facility_id", "left")

    def at_least_one(c: str):
        return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1))

    return out.select(
        "event_id",
        F.struct("id", "latitude", "longitude", "frp", "brightness_temperature", F.col("ts").alias("timestamp"),
                 "satellite").alias("event"),
        F.struct(F.coalesce("_p.classification", F.lit("unknown")).alias("classification"),
                 F.coalesce("_p.confidence", F.lit(0.0)).alias("confidence"),
                 F.coalesce(F.col("_p.risk_score").cast("double"), F.lit(0.0)).alias("risk_score"),
                 F.coalesce("_p.risk_level", F.lit("low")).alias("risk_level"),
                 F.coalesce("_p.explanation", F.array().cast("array<string>")).alias("explanation")).alias("prediction"),
        F.struct(F.coalesce("_f.id", "facility_id").alias("id"), F.coalesce("_f.name", "nearest_facility_name").alias("name"),
                 F.coalesce("_f.type", "facility_type").alias("type"), "distance_to_facility_m").alias("facility"),
        F.struct(at_least_one("detections_24h").alias("detections_24h"), at_least_one("detections_7d").alias("detections_7d"),
                 F.coalesce("persistence_score", F.lit(0.0)).alias("persistence_score")).alias("temporal"))


BASELINE_DAILY = 1.5


def facility_activity(facilities: DataFrame, events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Abnormality per facility: recent detections against 1.5 a day, and critical incidents."""
    scored = events.join(predictions.select("event_id", "risk_level"), "event_id", "left")
    recent = F.sum(F.coalesce(F.nullif(F.col("detections_24h"), F.lit(0)), F.lit(1)))
    seen = scored.groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("_total"), recent.alias("_recent"),
        F.count_if(F.lower("risk_level") == "critical").alias("_critical"))
    out = facilities.select("facility_id", "name", "facility_type").join(seen, "facility_id", "left")
    zero = F.lit(0).cast("long")
    out = out.select("facility_id", "name", "facility_type", F.coalesce("_total", zero).alias("total_detections"),
                     F.coalesce("_recent", zero).alias("recent_24h_detections"),
                     F.coalesce("_critical", zero).alias("critical_incidents"))
    recent = F.col("recent_24h_detections")
    return out.withColumns({
        "abnormality_status": F.when((recent > BASELINE_DAILY * 2) | (F.col("critical_incidents") > 0), "abnormal").otherwise("normal"),
        "deviation_percentage": F.when(recent > 0, F.bround((recent - BASELINE_DAILY) / BASELINE_DAILY * 100, 1)).otherwise(0.0)})


def facility_events(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Events of every facility with their predictions, one row each (a busy facility is never one array)."""
    pred = predictions.select("event_id", "classification", F.col("confidence").alias("class_confidence"), "risk_score",
                              "risk_level")
    return events.join(pred, "event_id", "left").select(
        "facility_id", "event_id", "latitude", "longitude", "frp", "brightness_temperature", "ts", "classification",
        "class_confidence", "risk_score", "risk_level")
