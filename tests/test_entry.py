"""The registry without the corpus subpackage or a library of it, and rows without a cluster."""

import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberline.operators.clusters import assign_clusters
from emberline.operators.split import spatial_temporal_split
from emberline.plans.training import training_dataset

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("absent", ["xxhash", "tokenizers", "emberline.llm", "corpus_pipeline"])
def test_core_queries_stay_without_the_corpus_part(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 130, len(q); print('clean_events' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "True", done.stderr[-500:]


def test_rows_without_a_cluster_stay_in_splits_and_training(spark):
    rows = [(i, f"E{i}", 10.0 + (i % 4), 70.0, 5.0 + i, 330.0, 60.0, datetime(2026, 1, 1 + i, 3), "N20") for i in range(20)]
    rows.append((20, "E20", None, 70.0, 5.0, 330.0, 60.0, datetime(2026, 1, 5, 3), "N20"))
    events = spark.createDataFrame(rows, "event_id long, id string, latitude double, longitude double, frp double, brightness_temperature double, confidence double, ts timestamp, satellite string")
    split = spatial_temporal_split(assign_clusters(events, 500.0)).select("event_id", "cluster_id", "split").collect()
    assert sorted(r.event_id for r in split) == list(range(21))
    assert [(r.cluster_id, r.split) for r in split if r.event_id == 20] == [(None, "test")]
    made = training_dataset(events).filter(F.col("event_id").isNotNull())
    assert made.count() == 21 and made.filter("event_id = 20 and cluster_size_500 is null").count() == 1


def test_multiplicity_difference_counts_rows(spark):
    from emberline.operators.analytics import multiplicity_difference
    kind = "id long, name string"
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], kind)
    after = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (3, "c"), (4, "d")], kind)
    got = sorted((r.id, r.before, r.after) for r in multiplicity_difference(before, after, ["id", "name"]).collect())
    assert got == [(1, 2, 1), (3, 1, 2), (4, 0, 1)]
    assert multiplicity_difference(before, before, ["id", "name"]).isEmpty()
