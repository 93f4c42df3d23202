"""Forests grown from counts against brute force and MLlib's own."""

import itertools
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from emberline.operators import forest


def gain(left, right):
    def sse(c):
        return sum(c) - sum(x * x for x in c) / sum(c)
    whole = [a + b for a, b in zip(left, right)]
    return (sse(whole) - sse(left) - sse(right)) / sum(whole)


def test_best_split_equals_brute_force():
    rng = random.Random(5)
    for k in (2, 4, 6):
        counts = np.array([[[rng.randrange(9) for _ in range(3)] for _ in range(8)] for _ in range(2)], float)
        counts[1, k:] = 0                     # a category: k codes
        counts[1, 0] += counts[0].sum(0)      # both features see the same rows
        counts[0, 0] += counts[1].sum(0) - counts[0].sum(0)
        tried = []
        for f, sides in ((0, [set(range(i)) for i in range(1, 8)]), (1, [set(s) for n in range(1, k) for s in itertools.combinations(range(k), n)])):
            for side in sides:
                left, right = counts[f, sorted(side)].sum(0), counts[f, sorted(set(range(8)) - side)].sum(0)
                if left.sum() and right.sum():
                    tried.append(gain(left, right))
        best, f, goes, left = forest.best_split(counts, np.array([0, 1]), {1: k})
        assert best == pytest.approx(max(tried)) and (counts[f, ~goes].sum(0) == left).all()
    assert forest.best_split(np.array([[[5.0, 0], [3, 0]]]), np.array([0]), {}) is None


def test_thresholds_lie_between_values():
    assert forest.thresholds_of(np.array([3.0, 1, 1, 2]), 64).tolist() == [1.5, 2.5] and not len(forest.thresholds_of(np.ones(3), 64))
    found = forest.thresholds_of(np.arange(1000.0), 10)
    assert len(found) == 9 and np.abs(np.diff(found) - 100).max() <= 2


def frame(spark, n):
    rows = (spark.range(n, numPartitions=5).select("id", (F.rand(1) * 10).alias("a"), F.floor(F.rand(2) * 4).cast("double").alias("b"), F.rand(3).alias("c"))
            .withColumn("label_index", F.when(F.rand(4) < 0.1, F.floor(F.rand(5) * 3)).when(F.col("a") > 6, 0).when(F.col("b").isin(0, 2), 1).otherwise(2).cast("double")))
    return VectorAssembler(inputCols=["a", "c", "b"], outputCol="features").transform(rows.localCheckpoint())


def scores(model, rows):
    p = vector_to_array("probability")
    out = model.transform(rows).select((F.col("prediction") == F.col("label_index")).cast("double").alias("hit"),
                                       (-F.log(F.element_at(p, (F.col("label_index") + 1).cast("int")))).alias("loss"))
    return out.agg(F.avg("hit"), F.avg("loss")).first()


def test_forest_is_as_good_as_mllibs(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 700)
    rows = frame(spark, 6000)
    train, test = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    own = forest.fit(train, ["a", "c"], {"b": 4}, 3, trees=30, depth=5, bins=32)
    assert own.getNumTrees == 30 and own.numFeatures == 3 and own.numClasses == 3
    theirs = RandomForestClassifier(labelCol="label_index", numTrees=30, maxDepth=5, subsamplingRate=0.8, seed=1).fit(train)
    (hit, loss), (hit2, loss2) = scores(own, test), scores(theirs, test)
    assert hit > hit2 - 0.02 and hit > 0.9 and abs(loss - loss2) < 0.12
    assert np.abs(own.featureImportances.toArray() - theirs.featureImportances.toArray()).max() < 0.1


def test_counts_are_bounded_and_every_row_is_counted(spark, monkeypatch):
    """MLlib walked every row through every tree; here a level is one pass, or as many as the counts' bytes ask for, over the same rows."""
    rows = frame(spark, 1500)
    whole = forest.fit(rows, ["a", "c"], {"b": 4}, 3, trees=6, depth=4, bins=16)
    passes, level = [], forest._level

    def counted(blocks, nodes, *rest):
        passes.append(len(nodes))
        return level(blocks, nodes, *rest)

    monkeypatch.setattr(forest, "_level", counted)
    monkeypatch.setattr(forest, "COUNT_BYTES", 2 * 2 * 16 * 3 * 4)
    split = forest.fit(rows, ["a", "c"], {"b": 4}, 3, trees=6, depth=4, bins=16)
    assert passes[:3] == [2, 2, 2] and max(passes) == 2
    assert whole.toDebugString.split("\n")[1:] == split.toDebugString.split("\n")[1:]
    one = forest.fit(rows, ["a", "c"], {"b": 4}, 3, trees=1, depth=2, rate=1.0)
    taken = sum(one.trees[0]._call_java("rootNode").impurityStats().stats())
    assert 1300 < taken < 1700
