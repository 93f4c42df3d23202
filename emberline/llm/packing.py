"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Documents are sorted into length classes and ranked inside each class: a rank is
counted per task and shifted by the counts of earlier tasks, so no class has to
meet in one place.  A superstep takes the longest class left and matches it with
the gaps in order of size: each free place goes to the smallest gap that holds
the class (its successor), as often as it fits, before the next larger one; new
sequences are opened when no gap is left.  Who gets which place is settled by
rank intervals, then gaps are updated and the next class follows.  Gaps of one
size are interchangeable, so a superstep works on counts; the plan has a few
intervals per class, bounded by the capacity and not by the data, and is applied
to all pieces by an equality join on length with a rank interval.  The result is
that of sequential best-fit-decreasing.

Defined cases: null text is empty and holds the end id only; repeated rows and
null ids are packed like any other row; a piece longer than the capacity can't
occur, longer documents are cut; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import gc
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import land, pieces, release_memory, table
from emberline.llm.encode import encoder
from emberline.llm.registry import query

CAPACITY, END_ID = 2048, 0
VOCABULARY = "word_bpe_49k.json"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text",
               id_col: str = "doc_id", remembered: int | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and its rank among the task's pieces of that length.

    ``remembered`` bounds the encoder's memory of chunks; the ids don't depend on it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, _task int, _rank bigint"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        coder = encoder(vocabulary, remembered)
        end = np.array([end_id], coder.dtype).tobytes()
        width, task = coder.dtype.itemsize, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        gc.disable()
        for batch in batches:
            for part in pieces(batch, text):
                owner, piece, start, length, crc = [], [], [], [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    ids = np.frombuffer(coder.encode(t or "") + end, coder.dtype).astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * at:4 * (at + capacity)]
                        owner.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                ranked = size[order]
                fresh = np.flatnonzero(np.diff(ranked, prepend=-1))
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.repeat(fresh, np.diff(np.append(fresh, len(size)))) + seen[ranked]
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), task, np.int32)), pa.array(rank)],
                    names=[id_col, "piece", "start", "length", "ids_crc32", "_task", "_rank"])

    return docs.select(id_col, text).mapInArrow(measure, schema)


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places of each length class: (length, first rank, end rank, first sequence, pieces in each, offset of the first)."""
    plan, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}          # gap -> runs of sequences (first, count) with that gap
    sizes: list[int] = []                                # the gaps, sorted

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(sizes, gap)
            gaps.setdefault(gap, []).append((first, count))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                gap = sizes[i]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[i]
            else:
                gap, first = capacity, sequences
                count = -(-(total - rank) // (capacity // length))
                sequences += count
            each = gap // length
            full = min(count, (total - rank) // each)
            placed = full * each
            if full < count and total - rank - placed:   # the last sequence takes fewer
                rest = total - rank - placed
                leave(gap - rest * length, first + full, 1)
                leave(gap, first + full + 1, count - full - 1)
                placed += rest
            else:
                leave(gap, first + full, count - full)
            plan.append((length, rank, rank + placed, first, each, capacity - gap))
            leave(gap - each * length, first, full)
            rank += placed
    return plan


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces (length, _task, _rank); lengths are 1 to ``capacity``."""
    spark = cut.sparkSession
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = land(cut.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n")), "packing-counts")
    shifts = per_task.select("length", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    # At most ``capacity`` classes, whatever the data.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = spark.createDataFrame(supersteps(counts, capacity), "_l bigint, _from bigint, _to bigint, _first bigint, _each bigint, _at bigint")
    ranked = cut.join(shifts, ["length", "_task"]).withColumn("_r", F.col("_rank") + F.col("_shift"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_l")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to")))
    nth = F.col("_r") - F.col("_from")
    return (placed.withColumn("sequence_id", F.col("_first") + F.floor(nth / F.col("_each")).cast("long"))
            .withColumn("offset", F.col("_at") + nth % F.col("_each") * F.col("length"))
            .select(*[c for c in cut.columns if c not in ("_task", "_rank")], "sequence_id", "offset"))


def pack_documents(docs: DataFrame, vocabulary: str = "", capacity: int = CAPACITY, remembered: int | None = None) -> DataFrame:
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    return pack(land(cut_pieces(docs, vocabulary, capacity, remembered=remembered), "packing-pieces"), capacity)


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
