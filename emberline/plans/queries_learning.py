"""Model queries (rows only: a fitted forest has no SQL equivalent)."""

from pyspark.sql import functions as F

from emberline.fixtures import view
from emberline.operators import learn, split
from emberline.operators.classify import MODEL_CATEGORICAL, MODEL_NUMERIC
from emberline.operators.clusters import assign_clusters
from emberline.operators.labels import evidence_label, weak_label
from emberline.plans.queries_spatial import det, infra
from emberline.plans.registry import query
from emberline.session import cut

CONTEXT = ["frp", "brightness_temperature", "detections_24h", "detections_7d", "detections_30d", "persistence",
           "hotspot_cluster_size", "distinct_dates", "span_days"]


def labelled(spark, sf):
    """Context rows with weak labels, whole-cluster split and typed-layer features."""
    from emberline.plans.enrich import enrich_with_infrastructure
    rows = weak_label(view(spark, sf, "fx_context").withColumn("persistence", F.col("persistence_score")))
    place = det(spark, sf).select("event_id", "latitude", "longitude", "ts", "satellite")
    parts = split.spatial_temporal_split(assign_clusters(place, 500.0))
    near = enrich_with_infrastructure(parts, infra(spark, sf))
    return cut(rows.join(near, "event_id"))     # training passes over it many times


@query("train_multiclass")
def train_multiclass(spark, sf):
    rows = labelled(spark, sf)
    model = learn.train_multiclass(rows.filter("split = 'train'"), CONTEXT, ["satellite"])
    return learn.score_test(model, rows.filter("split = 'test'"), ["event_id", "weak_label"])


@query("train_binary")
def train_binary(spark, sf):
    """Radiometric track, then the fused one (200 rounds of depth 5); what the view doesn't hold stays NULL and gets the training fills."""
    events = det(spark, sf).select("event_id", F.col("brightness_temperature").alias("bright_ti4"), "bright_ti5",
                                   F.hour("ts").cast("double").alias("acq_hour"), (F.col("confidence") / 100).alias("confidence_numeric"))
    near = {"log_distance_to_plant": "distance_to_plant_km", "log_distance_to_flare": "distance_to_flare_km",
            "log_distance_to_coal_mine": "distance_to_coal_mine_km", "log_min_industrial_distance": "min_distance_to_industrial_km"}
    rows = evidence_label(view(spark, sf, "fx_tracker").drop("confidence")).join(events, "event_id").withColumns(
        {"log_frp": F.log1p("frp"), "scan": F.lit(0.4), "track": F.lit(0.4), **{name: F.log1p(km) for name, km in near.items()}})
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in MODEL_NUMERIC if c not in rows.columns}
                            | {c: F.lit(None).cast("string") for c in MODEL_CATEGORICAL if c not in rows.columns})
    rows = cut(rows)        # read by both tracks
    _, radiometric = learn.train_binary(rows, learn.RADIOMETRIC)
    _, fused = learn.train_binary(rows, MODEL_NUMERIC, MODEL_CATEGORICAL, iterations=200, depth=5)
    report = [(track, *line) for track, lines in (("radiometric", radiometric), ("fused", fused)) for line in lines]
    return spark.createDataFrame(report, "track string, part string, metric string, value double")


@query("ablate")
def ablate(spark, sf):
    from emberline.operators.proximity import INFRASTRUCTURE_TYPES
    layers = [f"{t}_count_1km" for t in INFRASTRUCTURE_TYPES] + [f"nearest_{t}_distance_m" for t in INFRASTRUCTURE_TYPES] + [
        f"nearest_{t}_present" for t in INFRASTRUCTURE_TYPES]
    industrial = [c for c in layers if "wind_farm" not in c and "solar_plant" not in c]
    sets = {"baseline": CONTEXT, "with_layers": [*CONTEXT, *layers], "with_industrial_layers": [*CONTEXT, *industrial]}
    return learn.ablate(labelled(spark, sf), sets, ["satellite"])
