"""Importance resampling towards a target: hashed n-gram gains, a bisected threshold, range-partitioned ranks.

Features are the runs of one to ``RUN`` consecutive words; a feature's bucket is
the CRC-32 of its bytes.  Each task sums its buckets in one array, so counting
moves at most ``BUCKETS`` rows a task; the gains are an array of that size, and a
document's weight is the floored mean of what its features pick from it.  Scores
(weight plus seeded Gumbel noise) are written once.  The cut-off of the draw is
then found on numbers only: each job counts exactly how many rows lie above a few
probe values, which narrows the score, then among equal scores the id, then among
equal ids the stored row; no job sorts or collects rows.  Only drawn rows are
range-partitioned by the order of the draw, and a rank is the place in its
partition plus the counts of the partitions before.

The bytes of all words are hashed together, a byte position at a time; the hash of
two joined words follows from theirs, because CRC-32 is linear over bits.

Defined cases: null texts have no words, and a document without features has weight
0; null ids are hashed as an empty id and come last among ties; repeated rows are
drawn one by one, in the order in which they are stored; null target texts count for
nothing; without any target the gains compare with an even spread; an empty table
gives an empty result.  Columns other than id and text are not carried along.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import land, pieces, table, utf8
from emberline.llm.registry import query

RUN, BUCKETS, LEAST_WORDS, SHARE, SEED = 2, 10_000, 20, 25, 7
#: Probe values of one count job; words longer than this are hashed one by one.
PROBES, LONG_WORD = 31, 48
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_IN_WORD = np.array([b > 0x7F or chr(b).isalnum() for b in _FOLD.tolist()])


def _one_byte() -> np.ndarray:
    """CRC-32 remainders of single bytes, from its (reflected) polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_STEP = _one_byte()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _STEP[(state ^ byte) & 255] ^ (state >> 8)


def _shifts(longest: int) -> np.ndarray:
    """[n, k, b]: what byte k of a CRC, if b, turns into when n more bytes follow."""
    now = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(longest):
        now = _step(now, np.uint32(0))
        out.append(now)
    return np.array(out)


_SHIFTS = _shifts(LONG_WORD)


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text number) of all words of texts laid end to end."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _IN_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start, np.searchsorted(at, start, "right") - 1


def features(raw: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number) of every feature, and the number of words of each text."""
    start, size, owner = words_of(raw, at)
    folded = _FOLD[raw]
    order = np.argsort(-size, kind="stable")
    sizes, state = size[order], np.full(len(size), 0xFFFFFFFF, np.uint32)
    spots = start[order]
    lengthy = int(np.searchsorted(-sizes, -LONG_WORD, "left"))          # the words beyond LONG_WORD come first
    for j in range(int(sizes[lengthy]) if lengthy < len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))
        state[lengthy:n] = _step(state[lengthy:n], folded[spots[lengthy:n] + j])
    own = np.empty(len(size), np.uint32)
    own[order] = ~state
    word = lambda i: folded[start[i]:start[i] + size[i]].tobytes()      # noqa: E731
    for i in order[:lengthy].tolist():
        own[i] = zlib.crc32(word(i))
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    left, after = ~_step(~own[pair], np.uint32(32)), np.minimum(size[pair + 1], LONG_WORD)
    both = own[pair + 1].copy()
    for k in range(4):
        both ^= _SHIFTS[after, k, (left >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(size[pair + 1] > LONG_WORD).tolist():
        both[i] = zlib.crc32(word(pair[i] + 1), int(left[i]))
    bucket = np.concatenate([own, both]).astype(np.int64) % buckets
    return bucket, np.concatenate([owner, owner[pair]]), np.bincount(owner, minlength=len(at) - 1)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; summed in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                total += np.bincount(features(*utf8(part.column(text)), buckets)[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():   # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(all_source + n)) / (float(s + 1) * float(all_target + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, 1 << 20):
                bucket, owner, words = features(*utf8(part.column(text)), len(gain))
                n = np.bincount(owner, minlength=part.num_rows)
                total = np.bincount(owner, gain[bucket], part.num_rows).astype(np.int64)       # exact below 2^53
                weight = np.floor_divide(total, np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (words, n, weight)]],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias(text))
    return plain.mapInArrow(measure, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int = SEED) -> Column:
    """Seeded Gumbel noise of an id, in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def smallest_reaching(rows: DataFrame, key: Column, wanted: int) -> tuple[int, int]:
    """The smallest value with ``wanted`` rows up to it, and how many rows are below it; counts only, a few probes a job."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below = 0
    while low < high:
        width = high - low
        probes = sorted({low + width * i // (PROBES + 1) for i in range(1, PROBES + 1)} | {low})
        counts = rows.agg(*[F.count(F.when(key <= p, 1)).alias(f"p{i}") for i, p in enumerate(probes)]).first()
        for p, n in zip(probes, counts):
            if n >= wanted:
                high = p
                break
            low, below = p + 1, n
    return low, below


def drawn(rows: DataFrame, wanted: int) -> Column:
    """The condition that holds for the ``wanted`` first rows by score (highest first), doc_id (nulls last) and _row."""
    if wanted <= 0:
        return F.lit(False)
    worst, before = smallest_reaching(rows, -F.col("score"), wanted)
    above, tied = F.col("score") > -worst, F.col("score") == -worst
    rest, ties = wanted - before, rows.filter(tied)
    if rest == ties.count():
        return above | tied
    named = ties.filter("doc_id is not null")
    if rest > (n := named.count()):
        last, _ = smallest_reaching(ties.filter("doc_id is null"), F.col("_row"), rest - n)
        return above | (tied & (F.col("doc_id").isNotNull() | (F.col("_row") <= last)))
    last_id, fewer = smallest_reaching(named, F.col("doc_id"), rest)
    last, _ = smallest_reaching(named.filter(F.col("doc_id") == last_id), F.col("_row"), rest - fewer)
    first = (F.col("doc_id") < last_id) | ((F.col("doc_id") == last_id) & (F.col("_row") <= last))
    return above | (tied & F.coalesce(first, F.lit(False)))


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank``: the place by score (highest first), doc_id and _row, from range partitions and their counts."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("_row")]
    # The id of a row counts up inside its partition, so it has the place among the sorted rows.
    laid = land(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "importance-drawn")
    placed = laid.withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the only un-partitioned window.
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(offsets, "_part").withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
             id_col: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: ``share`` percent of the long enough rows have a rank, the others null."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    scored = land(weigh(docs, gain, id_col, text).withColumn("score", F.col("weight") + noise(seed))
                  .withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    long_enough = F.col("n_words") >= least_words
    able = scored.filter(long_enough)
    chosen = long_enough & drawn(able, share * able.count() // 100)
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.filter(chosen)).select(*out).unionByName(rest.select(*out))


@query("op12_importance")
def op12_importance(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
