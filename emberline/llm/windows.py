"""Repeated byte windows by a depth-limited radix sort of suffixes, most significant digits first.

Suffixes are ordered only through their first ``WINDOW`` bytes, and only as far as
a group still has more than one member.  The digits, taken in passes:

1. The anchor gram: the ``GRAM`` bytes with the least hash in the window.  Equal
   windows have equal grams at equal places, and neighbouring windows mostly share
   theirs, so a run of windows with one anchor is sorted as one row.  Grams that
   occur once end here, which is nearly all unique text.
2. The whole run: runs equal in all their windows are one group; all but the
   earliest are repeated from end to end.
3. The earliest runs of a gram that still differ are cut into parts of eight
   windows, keyed by the bytes that all eight share; keys that occur once end here,
   equal parts are one group.
4. What still differs is cut into single windows.

Equal groups after the last pass are exactly the repeated windows; the earliest
start of a group is the one that is not removed.  Two independent 64-bit hashes,
of the key and of the content, have to agree.  Passes 3 and 4 go back to the text
where it is scanned, so no text is moved.

Defined cases: null text is empty; texts below ``WINDOW`` bytes have no window;
documents are in order of id, nulls last, repeated ids in table order; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import BYTE_KEYS, Beside, land, lay_beside, mix, number_rows, pieces, powers, table, utf8
from emberline.llm.registry import query

WINDOW, GRAM = 100, 24
#: Bytes of text that are hashed at once; the arrays beside them take about 100 times as much.
PIECE_BYTES = 1 << 18
#: Windows of a part in the passes after the first.
WIDTHS = (8, 1)
_M = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, at least ``n`` of each."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        n = 1 << max(12, (n - 1).bit_length())
        _POWERS[base] = powers(base, n), powers(pow(base, -1, 2**64), n)
    return _POWERS[base]


class SpanHashes:
    """128-bit hashes of any spans of a byte buffer, from two sums over its prefixes."""

    def __init__(self, raw: np.ndarray):
        keys = BYTE_KEYS[raw]
        self.sums = []
        for base in _M:
            up, down = _tables(base, len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(keys * up[:len(raw)], out=total[1:])
            self.sums.append((total, down))

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(mix((s[end] - s[start]) * down[start]).view(np.int64) for s, down in self.sums)


def _gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on, by doubling."""
    part, have = BYTE_KEYS[raw], 1
    out, done = None, 0
    while True:
        if size & have:
            if out is None:
                out = part
            else:
                n = len(part) - done if len(part) > done else 0
                n = min(n, len(out))
                out = out[:n] * np.uint64(pow(_M[0], have, 2**64)) + part[done:done + n]
            done += have
        if done == size:
            return out
        n = len(part) - have
        if n <= 0:
            return np.zeros(0, np.uint64)
        part = part[:n] * np.uint64(pow(_M[0], have, 2**64)) + part[have:]
        have *= 2


def anchored_runs(raw: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows with one anchor: text number, anchor, first and last start (in the buffer), gram hash."""
    empty = np.zeros(0, np.int64)
    starts = len(raw) - window + 1
    if starts <= 0:
        return empty, empty, empty, empty, empty
    hashes = mix(_gram_hashes(raw, gram))
    # The leftmost position of the least hash: position in the low half of the key.
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    reach, want = 1, window - gram + 1
    while reach < want:
        step = min(reach, want - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    owner = (least[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(starts, bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= window:
            inside[a:b - window + 1] = True
    new = inside.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (owner[:-1] != owner[1:]) | ~inside[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    anchor = owner[first]
    return np.searchsorted(at, first, "right") - 1, anchor, first, last, hashes[anchor].view(np.int64)


def _names(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays.values()], names=list(arrays))


def run_rows(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(key, content, _ord, _row, run) of every run of windows with one anchor.

    run packs the first start, the anchor's distance from it and the number of
    further starts; key is the anchor gram's hash, content that of all bytes covered.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                raw, at = utf8(part.column(text))
                doc, anchor, first, last, gram = anchored_runs(raw, at, window)
                run = (first - at[doc]) << 16 | (anchor - first) << 8 | (last - first)
                yield _rows(part, doc, gram, SpanHashes(raw).of(first, last + window)[0], run)

    return docs.select("_row", "_ord", text).mapInArrow(measure, RUN)


RUN = "key bigint, content bigint, _ord bigint, _row bigint, run bigint"


def _rows(part: pa.RecordBatch, doc: np.ndarray, key: np.ndarray, content: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    where = pa.array(doc, pa.int64())
    return _names({"key": key, "content": content, "_ord": part.column("_ord").take(where), "_row": part.column("_row").take(where), "run": run})


def parts_of_runs(docs: DataFrame, runs: DataFrame, width: int, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Each run cut where the anchor's distance passes a multiple of ``width``; key is the hash of what all its windows share."""
    folder = lay_beside(runs.select("_row", "run"), f"window-runs-{width}")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Beside(folder)
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                many, own = side.of(part.column("_row").to_numpy())
                if own is None:
                    continue
                raw, at = utf8(part.column(text))
                doc = np.repeat(np.arange(part.num_rows), many)
                run = own.column("run").to_numpy()
                lead = run >> 8 & 255
                anchor, low = at[doc] + (run >> 16) + lead, lead - (run & 255)
                n = lead // width - low // width + 1
                doc, anchor, low, lead = (np.repeat(x, n) for x in (doc, anchor, low, lead))
                j = low // width + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                top, bottom = np.minimum(lead, j * width + width - 1), np.maximum(low, j * width)
                start, spans = anchor - top, SpanHashes(raw)
                shared = spans.of(anchor - j * width, anchor - (j * width + width - 1) + window)[0]
                content = spans.of(start, start + top - bottom + window)[1]
                yield _rows(part, doc, shared, content, (start - at[doc]) << 16 | top << 8 | (top - bottom))

    return docs.select("_row", "_ord", text).mapInArrow(measure, RUN)


def one_pass(rows: DataFrame, name: str, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Sort rows by key and content: spans of runs that repeat an earlier one, and the earliest runs of keys that still differ."""
    dealt = rows.repartition("key")                       # counted and filtered in one exchange
    often = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    alive = land(dealt.join(often, "key").withColumn("shape", F.col("run").bitwiseAND(65535)), f"window-{name}")
    group = ["key", "content", "shape"]
    groups = land(alive.groupBy(*group).agg(F.min(F.struct("_ord", "_row", "run")).alias("first"), F.count(F.lit(1)).alias("n")),
                  f"window-{name}-groups")
    copies = alive.join(groups.filter("n > 1").select(*group, F.col("first").alias("f")), group)
    copies = copies.filter((F.col("_row") != F.col("f._row")) | (F.col("run") != F.col("f.run")))
    start = F.shiftright("run", 16)
    spans = copies.select("_row", start.alias("start"), (start + F.col("run").bitwiseAND(255) + window).alias("end"))
    mixed = groups.groupBy("key").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("key")
    return land(spans, f"window-{name}-spans"), groups.join(mixed, "key").select("first._row", "first.run")


def repeated_spans(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(_row, start, end) of byte spans, each made of windows that start earlier too.

    ``docs`` is a file scan with _row (from ``number_rows``), text and _ord, which orders the documents.
    """
    found, runs = one_pass(run_rows(docs, window, text), "grams", window)
    for width in WIDTHS:
        more, runs = one_pass(parts_of_runs(docs, runs, width, window, text), f"parts-{width}", window)
        found = found.unionByName(more)
    return found


def digests(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the SHA-256 of what is left."""
    folder = lay_beside(spans, "window-spans")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Beside(folder)
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                raw, at = utf8(part.column(text))
                many, own = side.of(part.column("_row").to_numpy())
                start, end = (own.column(c).to_numpy() if own is not None else np.zeros(0, np.int64) for c in ("start", "end"))
                hi = np.cumsum(many)
                lo = hi - many
                out = np.zeros((part.num_rows, 3), np.int64)
                out[:, 0] = np.diff(at)
                sha = []
                for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
                    left = raw[at[i]:at[i + 1]]
                    if b > a:
                        steps = np.bincount(start[a:b], minlength=len(left) + 1) - np.bincount(end[a:b], minlength=len(left) + 1)
                        gone = np.cumsum(steps[:-1]) > 0
                        out[i, 1] = gone.sum()
                        out[i, 2] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
                        left = left[~gone]
                    sha.append(hashlib.sha256(left.tobytes()).hexdigest())
                yield _names({"doc_id": part.column("doc_id"), "n_bytes": out[:, 0], "n_removed": out[:, 1], "n_spans": out[:, 2],
                              "kept_sha256": pa.array(sha, pa.string())})

    return docs.select("doc_id", "_row", text).mapInArrow(
        measure, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


@query("op5_windows")
def op5_windows(spark, sf_dir):
    docs = number_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("_ord", F.coalesce("doc_id", F.lit(2**63 - 1)))
    return digests(docs, repeated_spans(docs))
