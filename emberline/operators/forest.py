"""Random forests for classification, grown level by level from counts.

The forest is the one of MLlib's ``RandomForestClassifier``: Gini impurity, Poisson
weights of the rows for each tree, ceil(sqrt(n)) of the n features in each node, at
most ``bins`` bins of a number (its thresholds are MLlib's: between the values of some
10,000 rows), all subsets of up to six categories and, beyond, those in order of their
impurity; siblings that predict the same class are one leaf.  Its samples are drawn by
other generators.  What is returned is MLlib's own model.

MLlib visits each row and tree one by one.  Here rows are cut into blocks once, one
byte a feature, and a task counts a level of all trees by array operations.  Counts are
added up by tree on the executors, which also choose the splits: the driver gets nodes,
never counts, and a task holds one block and at most ``COUNT_BYTES`` of counts.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import checkpoint_dir, cut

#: Rows of a block, bytes of counts that a task holds, rows that thresholds are learned from, categories up to which all subsets are tried.
BLOCK_ROWS, COUNT_BYTES, THRESHOLD_ROWS, MOST_SUBSETS = 1 << 15, 96 << 20, 10_000, 6


def thresholds_of(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 thresholds between different values, so that bins hold about as many of them (as MLlib has it)."""
    seen, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    between = (seen[:-1] + seen[1:]) / 2
    if len(between) <= bins - 1:
        return between
    stride = counts.sum() / bins
    out, upto, target = [], int(counts[0]), stride
    for i in range(1, len(seen)):
        before, upto = upto, upto + int(counts[i])
        if abs(before - target) < abs(upto - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out[:bins - 1])


def blocks_of(rows: DataFrame, numeric: list[str], categorical: list[str], label: str, thresholds: list[np.ndarray]) -> DataFrame:
    """(block, n, x, y): ``BLOCK_ROWS`` rows at most, a byte for each feature (all rows' first, then the next) and one for the class."""
    names = [*numeric, *categorical, label]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 32)

        def block(parts: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate(parts, axis=1)
            return pa.RecordBatch.from_arrays([pa.array([next(number)]), pa.array([x.shape[1]]), pa.array([x[:-1].tobytes()], pa.binary()),
                                               pa.array([x[-1].tobytes()], pa.binary())], names=["block", "n", "x", "y"])

        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            part = np.array([np.searchsorted(t, c) for t, c in zip(thresholds, columns)] + columns[len(thresholds):]).reshape(len(names), -1).astype(np.uint8)
            while part.shape[1]:
                some, part = part[:, :BLOCK_ROWS - size], part[:, BLOCK_ROWS - size:]
                held, size = [*held, some], size + some.shape[1]
                if size == BLOCK_ROWS:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    return rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names]).mapInArrow(measure, "block bigint, n bigint, x binary, y binary")


def _weights(rate: float) -> np.ndarray:
    """How often a row counts, for each value of 16 random bits: Poisson."""
    p = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(30)])
    return np.searchsorted(p, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _gain(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Decrease of Gini impurity by each split with the class counts ``left`` of ``total``; -1 if a side is empty."""
    right = total - left
    nl, nr = left.sum(-1), right.sum(-1)
    n = total.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.where(nl > 0, (left**2).sum(-1) / nl, 0) + np.where(nr > 0, (right**2).sum(-1) / nr, 0)
        return np.where((nl > 0) & (nr > 0), inside / n - (total**2).sum(-1) / n**2, -1.0)


def gini(counts: np.ndarray) -> float:
    n = counts.sum()
    return float(1 - ((counts / n) ** 2).sum()) if n else 0.0


def best_split(counts: np.ndarray, features: np.ndarray, arity: dict[int, int]) -> tuple[float, int, np.ndarray, np.ndarray] | None:
    """(gain, feature, which bins go right, class counts of the left side) of the best split; counts by (feature, bin, class)."""
    total = counts[0].sum(0)
    best = None
    for own, f in zip(counts, features.tolist()):
        if f in arity:
            k = arity[f]
            if k <= MOST_SUBSETS:
                right = np.array([[m >> c & 1 for c in range(k)] for m in range(1, 1 << (k - 1))], bool).reshape(-1, k)   # the last stays left
            else:
                order = np.argsort([gini(c) if c.sum() else np.inf for c in own[:k]], kind="stable")
                right = np.ones((k - 1, k), bool)
                for i in range(k - 1):
                    right[i, order[:i + 1]] = False
            right = np.pad(right, ((0, 0), (0, len(own) - k)))
            left = (~right).astype(np.float64) @ own
        else:
            left, right = own.cumsum(0)[:-1], None
        if not len(left):
            continue
        gains = _gain(left, total)
        i = int(gains.argmax())
        if gains[i] > 1e-15 and (best is None or gains[i] > best[0]):
            best = float(gains[i]), f, np.arange(len(own)) > i if right is None else right[i], left[i]
    return best


def fit(rows: DataFrame, numeric: list[str], categorical: dict[str, int], classes: int, label: str = "label_index", trees: int = 200,
        depth: int = 6, rate: float = 0.8, bins: int = 64, seed: int = 42) -> RandomForestClassificationModel:
    """A forest on the features ``numeric`` and ``categorical`` (codes, with the number of categories), in this order.

    ``label`` holds class numbers below ``classes``.  Numbers may not be null.
    """
    if max([classes, *categorical.values()]) > (1 << 8) or max([0, *categorical.values()]) > bins:
        raise ValueError("too many classes or categories")
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        raise ValueError("no training rows")
    few = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(numeric)]) if numeric else None
    if few is not None:
        asked = max(bins * bins, THRESHOLD_ROWS)
        few = (few.sample(False, asked / n, seed) if n > asked else few).toArrow()
    thresholds = [thresholds_of(few.column(i).to_numpy(), min(bins, n)) for i in range(len(numeric))]
    blocks = cut(blocks_of(rows, numeric, list(categorical), label, thresholds))
    blocks = cut(blocks.repartition(max(1, min(blocks.count(), spark.sparkContext.defaultParallelism))))

    n_features = len(numeric) + len(categorical)
    arity = {len(numeric) + i: k for i, k in enumerate(categorical.values())}
    some = min(n_features, math.ceil(math.sqrt(n_features))) if trees > 1 else n_features
    wide = max([bins, *arity.values()])
    often = _weights(rate)
    # Nodes by number: the children of i are 2 i + 1 and 2 i + 2.
    feature = np.full((trees, (2 << depth) - 1), -1, np.int16)
    right = np.zeros((trees, (1 << depth) - 1, wide), bool)
    stats: list[dict[int, np.ndarray]] = [{} for _ in range(trees)]
    gains: list[dict[int, float]] = [{} for _ in range(trees)]
    open_nodes: dict[int, list[int]] = {t: [0] for t in range(trees)}
    for level in range(depth):
        size = max((len(x) for x in open_nodes.values()), default=0) * some * wide * classes * 4
        if not size:
            break
        chosen: dict[int, np.ndarray] = {t: np.array([np.random.default_rng([seed, 1, t, i]).permutation(n_features)[:some] for i in nodes])
                                         for t, nodes in open_nodes.items()}
        each = max(1, COUNT_BYTES // size)
        left = sorted(open_nodes)
        found = []
        while left:
            group, left = left[:each], left[each:]
            found += _level(blocks, {t: open_nodes[t] for t in group}, {t: chosen[t] for t in group}, feature, right, often, classes, wide, arity, seed, level)
        open_nodes = {}
        for r in found:
            t, i = r["tree"], r["node"]
            stats[t][i] = np.array(r["total"])
            if r["feature"] < 0:
                continue
            feature[t, i], right[t, i], gains[t][i] = r["feature"], np.frombuffer(r["right"], bool), r["gain"]
            for child, own in ((2 * i + 1, np.array(r["left"])), (2 * i + 2, np.array(r["total"]) - np.array(r["left"]))):
                stats[t][child] = own
                if level + 1 < depth and gini(own) > 1e-15:
                    open_nodes.setdefault(t, []).append(child)
    return _model(spark, feature, right, stats, gains, thresholds, arity, n_features, classes, trees, depth, rate, bins, seed)


def _level(blocks: DataFrame, nodes: dict[int, list[int]], chosen: dict[int, np.ndarray], feature: np.ndarray, right: np.ndarray, often: np.ndarray,
           classes: int, wide: int, arity: dict[int, int], seed: int, level: int) -> list:
    """The best split of every open node of some trees: one pass over the blocks, the counts added up by tree."""
    trees = list(nodes)
    shared = blocks.sparkSession.sparkContext.broadcast((nodes, chosen, {t: feature[t].astype(np.int64) for t in trees}, {t: right[t, :max(1, (1 << level) - 1)] for t in trees}, often))   # bounded by the nodes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, chosen, feature, right, often = shared.value
        sums = {t: np.zeros((chosen[t].shape[1], len(own) * wide * classes), np.int32) for t, own in nodes.items()}
        place = {t: np.full((2 << level) - 1, -1, np.int64) for t in nodes}
        for t, own in nodes.items():
            place[t][own] = np.arange(len(own))
        for batch in batches:
            for block, n, x, y in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8).astype(np.int64)
                scaled = x.astype(np.int64) * classes
                for t in nodes:
                    times = often[np.random.default_rng([seed, 0, t, block]).integers(0, 1 << 16, n, np.uint16)]
                    at = np.flatnonzero(times != 0)
                    node = np.zeros(len(at), np.int64)
                    for _ in range(level):
                        f = feature[t].take(node)
                        if f.min(initial=0) < 0:                     # some have come to a leaf
                            on = f >= 0
                            at, node, f = at[on], node[on], f[on]
                        node = 2 * node + 1 + right[t][node, x.take(f * n + at)]
                    own = place[t].take(node)
                    if own.min(initial=0) < 0:
                        on = own >= 0
                        at, own = at[on], own[on]
                    cell, weight = own * (wide * classes) + y.take(at), times.take(at).astype(np.float64)
                    for j, add in enumerate(sums[t]):
                        starts = chosen[t][:, j] * n
                        key = scaled.take(starts.take(own) + at) + cell
                        add += np.bincount(key, weight, len(add)).astype(np.int32)
        if not sums:
            return
        for t, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["tree", "counts"])

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        nodes, chosen, *_ = shared.value
        t = key[0].as_py()
        total = sum(np.frombuffer(c.as_py(), np.int32).astype(np.float64) for c in table.column("counts"))
        out = []
        for i, features, own in zip(nodes[t], chosen[t], total.reshape(-1, len(nodes[t]), wide, classes).swapaxes(0, 1)):
            gain, f, goes, left = best_split(own, features, arity) or (0.0, -1, np.zeros(wide, bool), np.zeros(classes))
            out.append((t, i, f, gain, goes.tobytes(), left.tolist(), own[0].sum(0).tolist()))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["tree", "node", "feature", "gain", "right", "left", "total"])

    try:
        return (blocks.mapInArrow(count, "tree int, counts binary").groupBy("tree").applyInArrow(
            choose, "tree int, node int, feature int, gain double, right binary, left array<double>, total array<double>")).collect()
    finally:
        shared.destroy()


def _model(spark, feature, right, stats, gains, thresholds, arity, n_features, classes, trees, depth, rate, bins, seed) -> RandomForestClassificationModel:
    """MLlib's model of the grown trees, through the files that it saves and loads."""
    rows = []
    for t in range(trees):
        same = {}

        def leaf(i: int) -> bool:
            """Whether a node ends here: it wasn't split, or its children are leaves of the same class."""
            if i not in same:
                same[i] = feature[t, i] < 0 or (leaf(2 * i + 1) & leaf(2 * i + 2) and stats[t][2 * i + 1].argmax() == stats[t][2 * i + 2].argmax())
            return same[i]

        def add(i: int) -> int:
            own, at = stats[t][i], len(nodes)
            nodes.append(None)
            gain, children, split = -1.0, (-1, -1), (-1, [], -1)
            if not leaf(i):
                children = add(2 * i + 1), add(2 * i + 2)
                f, gain = int(feature[t, i]), gains[t][i]
                split = ((f, [float(c) for c in range(arity[f]) if not right[t, i, c]], arity[f]) if f in arity
                         else (f, [float(thresholds[f][int(right[t, i].argmax()) - 1])], -1))
            nodes[at] = (t, (at, float(own.argmax()), gini(own), own.tolist(), int(own.sum()), gain, *children, split))
            return at

        nodes: list = []
        add(0)
        rows += nodes
    path = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    kind = "org.apache.spark.ml.classification."

    def about(name: str, uid: str, **more) -> str:
        params = {"labelCol": "label_index", "featuresCol": "features", "maxDepth": depth, "maxBins": bins, "seed": seed, "impurity": "gini"}
        return json.dumps({"class": kind + name, "timestamp": 0, "sparkVersion": spark.version, "uid": uid, "paramMap": params | ({"numTrees": trees, "subsamplingRate": rate} if more else {}),
                           "defaultParamMap": {}, **more})

    top = about("RandomForestClassificationModel", f"RandomForestClassifier_{uuid.uuid4().hex[:12]}", numFeatures=n_features, numClasses=classes, numTrees=trees)
    spark.createDataFrame([(top,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(t, about("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}"), 1.0) for t in range(trees)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    split = "struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
    spark.createDataFrame(rows, "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
                                f"leftChild:int,rightChild:int,split:{split}>", verifySchema=False).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
