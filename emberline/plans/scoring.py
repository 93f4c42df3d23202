"""The scoring job: features, class, risk, triage, explanation for a whole table, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.classify import MODEL_NAME, Classifier, classify_baseline
from emberline.operators.explain import explain
from emberline.operators.features import canonical_label, engineer
from emberline.operators.risk import risk_score, triage


def predict(events: DataFrame, classifier: Classifier = classify_baseline, model_name: str = MODEL_NAME,
            id_col: str = "event_id") -> DataFrame:
    """One prediction row per event.

    ``classifier`` takes an engineered frame and adds ``classification`` and
    ``class_confidence``; any DataFrame function (a fitted model's included)
    can be plugged in.
    """
    labelled = classifier(engineer(events)).withColumn("classification", canonical_label(F.col("classification")))
    scored = explain(triage(risk_score(labelled)))
    return scored.select(
        F.col(id_col).alias("event_id"), "classification", F.col("class_confidence").alias("confidence"), "risk_score",
        "risk_level", "recommended_tier", "triage_required", "action", "explanation", "anomaly_ratio",
        "persistence_score", F.lit(model_name).alias("model_version"))
