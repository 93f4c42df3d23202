"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed byte n-grams of its whole text
(letters lower-cased, other ASCII signs as blanks).  Document frequencies are
counted over all training rows of either label; a feature that is frequent enough
and tells the labels apart enters with its log-count ratio as value, and a
logistic regression learns weights on a bounded sample of training rows.

Defined cases: null and empty texts have no feature and get the intercept's score;
null labels are not learned from; documents labelled twice count once per label
row; if only one label is there, every score is the smoothed share of label 1; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import Beside, held_out, land, lay_beside, mix, number_rows, pieces, table, utf8
from emberline.llm.registry import query

SIZES, BUCKETS = (4, 5), 1 << 20
#: Least documents with a feature, features used, training rows of each label in the sample of the fit.
LEAST_DOCS, FEATURES, SAMPLE_ROWS = 8, 4096, 6000
CUT = 0.3
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def gram_buckets(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of all n-grams inside texts, a size at a time."""
    folded = _FOLD[raw].astype(np.uint64)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    for size in SIZES:
        n = len(folded) - size + 1
        if n <= 0:
            continue
        packed = folded[:n].copy()
        for j in range(1, size):
            packed = (packed << np.uint64(8)) | folded[j:j + n]
        inside = owner[:n] == owner[size - 1:]
        bucket = (mix(packed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)) >> np.uint64(44)).astype(np.int64)
        yield bucket[inside], owner[:n][inside]


def _distinct(bucket: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(owner.astype(np.int64) * BUCKETS + bucket)
    return pair % BUCKETS, pair // BUCKETS


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of stored ``docs`` (_row, doc_id, text, held_out) that may be learned from, one row per label row.

    Ids meet labels without any text; each scan task then reads the labels of its own rows.
    """
    side = docs.filter("not held_out").select("_row", "doc_id").join(labels, "doc_id").select("_row", "label")
    folder = lay_beside(side, "toxicity-labels")

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Beside(folder)
        for batch in batches:
            for part in pieces(batch, "text"):
                many, own = side.of(part.column("_row").to_numpy())
                if own is not None:
                    took = part.take(pa.array(np.repeat(np.arange(part.num_rows), many)))
                    yield pa.RecordBatch.from_arrays([took.column("doc_id"), took.column("text"), own.column("label").combine_chunks()],
                                                     names=["doc_id", "text", "label"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("_row", "doc_id", "text").mapInArrow(attach, f"doc_id {kind}, text string, label int")


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): training documents of either label with the feature; summed in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                raw, at = utf8(part.column("text"))
                label = part.column("label").to_numpy()
                for bucket, owner in gram_buckets(raw, at):
                    b, o = _distinct(bucket, owner)
                    for y in (0, 1):
                        total[y] += np.bincount(b[label[o] == y], minlength=BUCKETS).astype(np.int32)
        found = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[1, found].astype(np.int64)),
                                          pa.array(total[0, found].astype(np.int64))], names=["bucket", "toxic", "clean"])

    parts = rows.select("text", "label").mapInArrow(count, "bucket int, toxic bigint, clean bigint")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def featured(rows: DataFrame, buckets: np.ndarray, values: np.ndarray) -> DataFrame:
    """(label, ids, vals): the chosen features of each row."""
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    shared = rows.sparkSession.sparkContext.broadcast((place, values))        # bounded by BUCKETS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, value = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                raw, at = utf8(part.column("text"))
                ids, owners = [], []
                for bucket, owner in gram_buckets(raw, at):
                    hit = where[bucket]
                    ids.append(hit[hit >= 0])
                    owners.append(owner[hit >= 0])
                pair = np.unique(np.concatenate(owners or [np.zeros(0, int)]).astype(np.int64) * BUCKETS
                                 + np.concatenate(ids or [np.zeros(0, int)]))
                own, f = pair // BUCKETS, (pair % BUCKETS).astype(np.int32)
                offsets = pa.array(np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.ListArray.from_arrays(offsets, pa.array(f)), pa.ListArray.from_arrays(offsets, pa.array(value[f]))],
                    names=["label", "ids", "vals"])

    return rows.select("text", "label").mapInArrow(measure, "label int, ids array<int>, vals array<double>")


def learn(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the intercept, from stored rows (doc_id, text, label)."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    weights = np.zeros(BUCKETS)
    prior = float(np.log((toxic + 1) / (clean + 1)))
    if not toxic or not clean:
        return weights, prior
    least = min(LEAST_DOCS, max(1, min(toxic, clean) // 4))
    spread = F.abs(F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(
        (F.col("toxic") + F.col("clean")) / float(toxic + clean) * (1 / toxic + 1 / clean))
    found = (document_frequencies(rows).filter(F.col("toxic") + F.col("clean") >= least)
             .orderBy(spread.desc(), "bucket").limit(FEATURES).collect())          # the features of the model
    if not found:
        return weights, prior
    buckets = np.array([r["bucket"] for r in found])
    p, q = np.array([r["toxic"] for r in found]) + 1.0, np.array([r["clean"] for r in found]) + 1.0
    ratio = np.log((p / (toxic + 2)) / (q / (clean + 2)))
    share = F.when(F.col("label") == 1, min(1.0, SAMPLE_ROWS / toxic)).otherwise(min(1.0, SAMPLE_ROWS / clean))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < share * (1 << 20))
    data = land(featured(sample, buckets, ratio), "toxicity-features")
    drawn = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(drawn) < 2:
        return weights, prior
    width = len(buckets)
    vector = F.udf(lambda i, v: SparseVector(width, i, v), VectorUDT())       # the sample only
    fit = LogisticRegression(regParam=1e-3, maxIter=40, standardization=False, featuresCol="f", labelCol="label").fit(
        data.select(F.col("label").cast("double").alias("label"), vector("ids", "vals").alias("f")))
    weights[buckets] = fit.coefficients.toArray() * ratio
    # The sample's shares of the labels are not the table's.
    shift = np.log(toxic / clean) - np.log(drawn[1] / drawn[0])
    return weights, float(fit.intercept + shift)


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """Replace the text by score and predicted."""
    kept = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(weights)               # bounded by BUCKETS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = shared.value
        active = used != 0
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, at = utf8(part.column("text"))
                total = np.full(part.num_rows, intercept)
                for bucket, owner in gram_buckets(raw, at):
                    hit = active[bucket]
                    b, o = _distinct(bucket[hit], owner[hit])
                    total += np.bincount(o, used[b], part.num_rows)
                value = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(value), pa.array((value >= CUT).astype(np.int32))],
                                                 names=[*kept, "score", "predicted"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept], "score double", "predicted int"])
    return docs.select(*[f"`{c}`" for c in kept], "text").mapInArrow(measure, schema)


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    rows = labelled(number_rows(docs), labels)
    weights, intercept = learn(land(rows, "toxicity-rows"))
    return score(docs, weights, intercept)
