"""Training table: time, temporal, baseline and cluster features with weak labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.timefeat import daynight, time_features
from emberline.operators import clusters, enrichment
from emberline.operators.labels import RULES_V1, weak_label

COLUMNS = [
    "id", "latitude", "longitude", "frp", "brightness_temperature", "confidence", "ts", "satellite", "daynight", "hour_utc",
    "day_of_week", "month", "detections_24h", "detections_7d", "detections_30d", "persistence", "persistence_score",
    "hotspot_cluster_size", "facility_baseline", "facility_current_activity", "facility_anomaly", "current_activity",
    "activity_anomaly", "cluster_size_500", "distinct_dates", "span_days", "cluster_id", "weak_label", "label_confidence",
    "label_source", "label_reasons", "confidence_level"]
FEATURES = [
    "latitude", "longitude", "frp", "brightness_temperature", "confidence", "hour_utc", "day_of_week", "month",
    "detections_24h", "detections_7d", "detections_30d", "persistence", "hotspot_cluster_size", "facility_baseline",
    "facility_current_activity", "facility_anomaly", "cluster_size_500", "distinct_dates", "span_days"]
CATEGORICAL = ["satellite", "daynight"]


def training_dataset(events: DataFrame, daynight_lookup: DataFrame | None = None, id_col: str = "event_id") -> DataFrame:
    """The fixed 32 columns plus the clustering id column; history is the table itself, strictly earlier only.

    One row in, one row out: a row without a position has no cluster and NULL cluster columns.
    """
    out = enrichment.temporal_context(daynight(time_features(events), daynight_lookup))
    out = out.withColumns({"persistence": F.col("persistence_score"), "facility_current_activity": F.col("current_activity"),
                           "facility_anomaly": F.col("activity_anomaly")})
    clustered = clusters.assign_clusters(events.select(id_col, "latitude", "longitude", "ts"), 500.0, id_col)
    stats = clustered.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size_500"), F.countDistinct(F.to_date("ts")).alias("distinct_dates"),
        F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000).cast("long").alias("span_days"))
    member = clustered.select(id_col, "cluster_id").join(stats, "cluster_id", "left")
    out = weak_label(out.join(member, id_col, "left"))
    out = out.withColumn("label_reasons", F.concat_ws(",", "label_reasons"))
    return out.select(*([id_col] if id_col not in COLUMNS else []), *COLUMNS)


def label_feature_names(spark) -> DataFrame:
    """Base names of the features that the label rules test (text before the comparison)."""
    names = spark.createDataFrame([(n,) for _, n, _ in RULES_V1], "rule string")
    return names.select(F.regexp_extract("rule", "^([a-zA-Z_][a-zA-Z0-9_]*)", 1).alias("feature")).distinct()


def training_feature_names(df: DataFrame) -> DataFrame:
    """Names of the columns that hold any value in the data."""
    seen = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return seen.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in df.columns])).alias("_r")
                       ).filter("_r.n > 0").select("_r.feature")
