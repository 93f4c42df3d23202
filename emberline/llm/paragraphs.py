"""Substring dedup by paragraphs: MinHash bands, exact Jaccard, components; and passages inside of paragraphs.

A paragraph is a line with at least ``LEAST_WORDS`` words.  Equal paragraphs are
collapsed first.  Each distinct paragraph has ``BANDS`` bands of ``ROWS`` minima over
its five-word shingles: at similarity 0.8 a pair meets in some band with probability
1 - (1 - 0.8^3)^10 = 0.9992.  In a band bucket every paragraph is first compared with
the most frequent one.  Those that don't match it meet the members that these links
haven't joined with them by an exact prefix filter: only pairs that share one of their
rarest shingles can reach the similarity, and a bitmap of each set tells inside that
join how many shingles at least are not shared.  Verified links form components; of
each, the first occurrence in the table stays.

A passage that is wrapped otherwise, or stands inside a longer line, is no paragraph of
its own.  So the whole text is also cut into pieces at places that its words decide
(where a word pair's hash is the least among the ``REACH`` pairs on both sides), whatever
the line breaks: inside a repeated passage, beyond ``REACH`` words from its ends, the
cuts are the same everywhere.  A piece that stood earlier in the table is repeated, and
consecutive repeated pieces of ``LEAST_RUN`` words or more go; shorter repetitions stay.

Defined cases: null and empty texts have no paragraph and stay as they are;
repeated rows are separate documents, the later ones lose their paragraphs; ties
go to the earlier row, then the earlier place; an empty table gives an empty
result; other columns are kept and may have any name but ``_row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import (BYTE_KEYS, IS_SPACE, SPACES, Beside, land, lay_beside, link_groups, mix, number_rows, pieces, powers,
                                  schema_of, table, utf8)
from emberline.llm.registry import query

LEAST_WORDS, SHINGLE, SIMILARITY = 25, 5, 0.8
#: Word pairs on each side of a cut that it is compared with, least words of consecutive repeated pieces.
REACH, LEAST_RUN = 6, 16
#: Bytes of text that are hashed at once; the arrays beside them take about 100 times as much.
PIECE_BYTES = 1 << 18
BANDS, ROWS = 10, 3
#: The 64-bit words of the bitmap of a shingle set.
MAPS = [f"m{i}" for i in range(16)]
#: How many preceding prefix shingles a row of the prefix join carries, to tell that its pair was met before.
BEHIND = 32
_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)
_M, _K1, _K2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _keys(words: np.ndarray, start: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of words that follow one another."""
    if not len(n_words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(words)) - np.repeat(start, n_words)
    top = int(n_words.max()) + 1
    return tuple(mix(np.add.reduceat(words * powers(k, top)[place], start)).view(np.int64) for k in (_K1, _K2))


class Paragraphs:
    """The paragraphs of a batch of texts: where they are, their keys, and their shingle hashes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, least_words: int = LEAST_WORDS):
        solid = ~IS_SPACE[raw]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = at[:-1][at[:-1] < at[1:]]
        begins[inner] = solid[inner]
        word_at = np.flatnonzero(begins)
        # Lines are numbered through the batch; a document starts a new one.
        breaks = np.cumsum(raw == 10)
        doc = np.searchsorted(at, word_at, "right") - 1
        before = np.concatenate([[0], breaks])
        line = before[word_at]                                 # newlines before the word, in the batch
        new = np.ones(len(word_at), bool)
        new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        n_words = np.diff(np.append(first, len(word_at)))
        body = _LOWER[raw[solid]]
        starts = np.cumsum(solid)[word_at] - 1 if len(word_at) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(body)))
        place = np.arange(len(body)) - np.repeat(starts, lengths)
        weight = powers(_M, int(lengths.max(initial=0)) + 1)
        words = mix(np.add.reduceat(BYTE_KEYS[body] * weight[place], starts)) if len(starts) else np.zeros(0, np.uint64)
        #: Of all words: hash, document, and first byte; lead bytes before each byte.
        self.all_words, self.word_doc, self.word_at = words, doc, word_at
        self.raw, self.text_at = raw, at
        # Only the lines with enough words.
        use = n_words >= least_words
        keep = np.repeat(use, n_words)
        self.words, self.n_words = words[keep], n_words[use]
        self.doc = doc[first][use]
        self.word = first[use]                                      # the first word of each
        self.line = (line[first] - before[at[doc[first]]])[use]     # counted from the document's start
        self.start = np.concatenate([[0], np.cumsum(self.n_words)[:-1]]).astype(np.int64) if len(self.n_words) else np.zeros(0, np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each paragraph's words in order."""
        return _keys(self.words, self.start, self.n_words)

    def line_spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First character of each paragraph's line and the one after its line break, from the document's start."""
        breaks = np.flatnonzero(self.raw == 10)
        here = self.word_at[self.word]
        own, last = self.text_at[self.doc], self.text_at[self.doc + 1]
        k = np.searchsorted(breaks, here)
        padded = np.concatenate([[-1], breaks, [len(self.raw)]])
        return self._characters(np.maximum(padded[k] + 1, own), own), self._characters(np.minimum(padded[k + 1] + 1, last), own)

    def _characters(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        leads = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])
        return leads[at] - leads[own]

    def pieces(self, reach: int = REACH) -> dict[str, np.ndarray]:
        """The content-defined pieces: doc, number in it, n_words, two hashes, first character and the one after the last."""
        words, doc = self.all_words, self.word_doc
        n = len(words)
        follows = np.zeros(n, np.uint64)
        if n:
            follows[:-1] = np.where(doc[1:] == doc[:-1], words[1:], np.uint64(0))
        value = mix(words * np.uint64(_K1) + follows * np.uint64(_K2))
        # Documents stand ``reach`` places apart, so that none decides on another's cuts.
        rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) if n else np.zeros(0, np.int64)
        spot = np.arange(n) + (rank + 1) * reach
        wide = np.full(n + (int(rank[-1]) + 2 if n else 1) * reach + 1, np.iinfo(np.uint64).max)
        wide[spot] = value
        least_before, least_after = np.full(n, np.iinfo(np.uint64).max), np.full(n, np.iinfo(np.uint64).max)
        for j in range(1, reach + 1):
            least_before, least_after = np.minimum(least_before, wide[spot - j]), np.minimum(least_after, wide[spot + j])
        new = (value < least_before) & (value <= least_after)
        if n:
            new[0] = True
            new[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        k1, k2 = _keys(words, first, size)
        own_doc = doc[first]
        begins = np.searchsorted(own_doc, own_doc, "left")                     # the first piece of the same document
        start = self.word_at[first]
        stop = np.append(start[1:], 0)
        last = np.append(own_doc[1:] != own_doc[:-1], True) if len(first) else np.zeros(0, bool)
        stop[last] = self.text_at[own_doc[last] + 1]
        own = self.text_at[own_doc]
        return {"doc": own_doc, "piece": np.arange(len(first)) - begins, "n_words": size, "k1": k1, "k2": k2,
                "at": self._characters(start, own), "till": self._characters(stop, own)}

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all word shingles and each paragraph's first one; every paragraph has at least one."""
        count = np.maximum(self.n_words - size + 1, 1)
        at = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if len(count) else np.zeros(0, np.int64)
        spot = np.repeat(self.start - at, count) + np.arange(count.sum())
        out = np.zeros(len(spot), np.uint64)
        scale = powers(_K1, size)
        for j in range(size):
            inside = np.minimum(spot + j, len(self.words) - 1)
            out += self.words[inside] * scale[j]
        return mix(out), at


def paragraph_bands(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per paragraph of ``docs`` (_row, text): _row, line, n_words, its characters, k1, k2 and its band hashes b0, b1, ..."""
    names = ["_row", "line", "n_words", "at", "till", "k1", "k2", *[f"b{i}" for i in range(BANDS)]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                found = Paragraphs(*utf8(part.column(text)), least_words)
                if not len(found.n_words):
                    continue
                rows = part.column("_row").take(pa.array(found.doc))
                hashes, at = found.shingles()
                bands = np.zeros((BANDS, len(at)), np.uint64)
                for i in range(BANDS * ROWS):
                    least = np.minimum.reduceat(hashes * _A[i] + _B[i], at)
                    bands[i // ROWS] = (bands[i // ROWS] + least) * np.uint64(_K2) + np.uint64(i)
                arrays = [rows, pa.array(found.line.astype(np.int32)), pa.array(found.n_words.astype(np.int32)),
                          *[pa.array(x) for x in found.line_spans()], *[pa.array(k) for k in found.keys()], *[pa.array(mix(b.copy()).view(np.int64)) for b in bands]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("_row", text).mapInArrow(
        measure, "_row bigint, line int, n_words int, at bigint, till bigint, k1 bigint, k2 bigint, " + ", ".join(f"b{i} bigint" for i in range(BANDS)))


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(pid, shingles, bitmap m0, m1, ...) of the ``wanted`` paragraphs (pid, first_row, k1, k2), read from their documents."""
    folder = lay_beside(wanted.select(F.col("first_row").alias("_row"), "k1", "k2", "pid"), "paragraph-wanted")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(folder)
        for batch in batches:
            many, side = beside.of(batch.column("_row").to_numpy())
            if side is None:
                continue
            named = list(zip(zip(side.column("k1").to_pylist(), side.column("k2").to_pylist()), side.column("pid").to_pylist()))
            ends_of = np.cumsum(many)
            asked = [dict(named[e - m:e]) for e, m in zip(ends_of[many > 0].tolist(), many[many > 0].tolist())]
            for part in pieces(batch.filter(pa.array(many > 0)), text, PIECE_BYTES):
                here, asked = asked[:part.num_rows], asked[part.num_rows:]
                found = Paragraphs(*utf8(part.column(text)), least_words)
                hashes, at = found.shingles()
                ends = np.append(at[1:], len(hashes))
                pids, sets = [], []
                for i, (d, k1, k2) in enumerate(zip(found.doc.tolist(), *[k.tolist() for k in found.keys()])):
                    pid = here[d].pop((k1, k2), None)
                    if pid is not None:
                        pids.append(pid)
                        sets.append(np.unique(hashes[at[i]:ends[i]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(sets, pa.list_(pa.int64())), *bitmaps(sets)],
                                                 names=["pid", "shingles", *MAPS])

    return docs.select("_row", text).mapInArrow(measure, "pid bigint, shingles array<bigint>, " + ", ".join(f"{m} bigint" for m in MAPS))


def bitmaps(sets: list[np.ndarray]) -> list[pa.Array]:
    """The words of each set's bitmap, which has one bit set for each hash."""
    hashes = np.concatenate([np.zeros(0, np.int64), *sets]).view(np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(MAPS), len(sets)), np.uint64)
    np.bitwise_or.at(out, ((hashes >> np.uint64(6)) % np.uint64(len(MAPS)), owner), np.uint64(1) << (hashes & np.uint64(63)))
    return [pa.array(word.view(np.int64)) for word in out]


def _distance() -> Column:
    both = F.size(F.array_intersect("sa", "sb"))
    return 1 - both / (F.size("sa") + F.size("sb") - both)


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact Jaccard distance of each pair (a, b).

    Catalyst counts one element for an array, so it takes the shingles for a small part of their
    file: they are merged, never broadcast.
    """
    a, b = sets.select(F.col("pid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("pid").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", _distance().alias("dist"))


def similar_links(docs: DataFrame, reps: DataFrame, similarity: float = SIMILARITY, text: str = "text",
                  least_words: int = LEAST_WORDS) -> DataFrame:
    """Verified links (a, b) that join the similar ones of the distinct paragraphs ``reps`` (pid, copies, first_row, k1, k2, b0, ...).

    Their components are those of all similar pairs.  A large group of variants is
    joined by its links to pivots; among themselves its members are not paired.
    """
    limit = 1 - similarity + 1e-9
    rows = reps.select("pid", "copies", F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("bucket"))
    bucket = Window.partitionBy("bucket").orderBy(F.desc("copies"), "pid").rowsBetween(Window.unboundedPreceding, 0)
    members = land(rows.withColumn("pivot", F.first("pid").over(bucket)).filter("pid <> pivot").select("bucket", "pivot", "pid"),
                   "paragraph-buckets")
    stars = members.select(F.col("pivot").alias("a"), F.col("pid").alias("b")).distinct()
    wanted = stars.select(F.explode(F.array("a", "b")).alias("pid")).distinct()
    sets = land(shingle_sets(docs, reps.select("pid", "first_row", "k1", "k2").join(wanted, "pid"), text, least_words), "paragraph-sets")
    near = land(_measured(stars, sets), "paragraph-stars")
    # What doesn't match its pivot may match another member of the bucket.
    placed = members.join(near.withColumnsRenamed({"a": "pivot", "b": "pid"}), ["pivot", "pid"])
    lost = land(placed.filter(F.col("dist") > limit).select("bucket", "pid"), "paragraph-lost")
    company = (members.join(lost.select("bucket").distinct(), "bucket").select("pid").distinct()
               .join(lost.select("pid").distinct().withColumn("lost", F.lit(True)), "pid", "left"))
    # Only pairs of different groups can join anything that the pivots didn't.
    joined = land(link_groups(near.filter(F.col("dist") <= limit)), "paragraph-joined")
    grouped = company.join(joined, F.col("pid") == F.col("node"), "left").select("pid", "lost", F.coalesce("component", "pid").alias("joined"))
    others = _measured(_prefix_pairs(sets.hint("merge").join(grouped, "pid"), similarity), sets).filter(F.col("dist") <= limit)
    return joined.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(others.select("a", "b"))


def _prefix_pairs(items: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different ``joined`` groups, a lost, that may reach ``similarity``: they share one of their rarest shingles.

    Two sets of similarity t share an element among the first n - ceil(t n) + 1 of
    each in any common order, and at the first one enough elements must lie ahead
    in both.  Rare ones come first, so variants meet only where they share an edit.
    A bit that only one of two bitmaps has stands for at least one shingle that
    only that set has, so too many of them rule the pair out, whatever the sizes.
    A pair with several common shingles is taken at the first: each row carries the
    ``BEHIND`` shingles before its own, and the join leaves out what they share.
    What lies further back only repeats a pair, which the last step merges.
    """
    each = items.select("pid", "lost", "joined", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rare = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    order = each.join(rare.filter("df > 1"), "s").groupBy("pid", "lost", "joined", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))                    # shingles of one paragraph
    # Shingles that nobody else has come first and join nothing: they only use up the prefix.
    length = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    mapped = order.filter(length > 0).join(items.select("pid", *MAPS), "pid")
    head = mapped.select("pid", "lost", "joined", "n", *MAPS, (F.col("n") - F.size("shared")).alias("own"), "shared",
                         F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))).alias("i", "x"))
    # What can still be shared from this shingle on, itself included.
    back = F.least(F.col("i"), F.lit(BEHIND))
    head = head.select("pid", "lost", "joined", "n", *MAPS, (F.col("n") - F.col("own") - F.col("i")).alias("ahead"), F.col("x.s").alias("s"),
                       F.slice("shared.s", F.col("i") - back + 1, back).alias("behind"))
    a, b = head.filter("lost").alias("a"), head.alias("b")
    only_a, only_b = (" + ".join(f"bit_count({x}.{m} & ~{y}.{m})" for m in MAPS) for x, y in ("ab", "ba"))
    alike = F.expr(f"a.joined <> b.joined and least(a.ahead, b.ahead, a.n - ({only_a}), b.n - ({only_b})) >= {similarity / (1 + similarity)!r}D * (a.n + b.n) - 1e-6D "
                   "and (b.lost is null or a.pid < b.pid) and not arrays_overlap(a.behind, b.behind)")
    return (a.join(b, (F.col("a.s") == F.col("b.s")) & alike)
            .select(F.col("a.pid").alias("a"), F.col("b.pid").alias("b")).distinct())


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """Lines to remove from stored ``docs`` (_row, text): (_row, line, at, till, keep_row), keep_row holding the copy that stays."""
    found = land(paragraph_bands(docs, text, least_words), "paragraphs")
    reps = found.groupBy("k1", "k2").agg(F.min("_row").alias("first_row"), F.count(F.lit(1)).alias("copies"),
                                         *[F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)])
    reps = land(reps.withColumn("pid", F.monotonically_increasing_id()), "paragraph-reps")
    roots = link_groups(land(similar_links(docs, reps, similarity, text, least_words), "paragraph-links"))
    grouped = reps.select("pid", "k1", "k2", "first_row", "copies").join(roots, F.col("pid") == F.col("node"), "left")
    repeated = land(grouped.filter("copies > 1 or node is not null")
                    .select("k1", "k2", "first_row", F.coalesce("component", "pid").alias("class")), "paragraph-classes")
    keep = repeated.groupBy("class").agg(F.min("first_row").alias("keep_row"))
    placed = land(found.select("_row", "line", "at", "till", "k1", "k2").join(repeated.join(keep, "class").drop("first_row"), ["k1", "k2"])
                  .select("_row", "line", "at", "till", "class", "keep_row"), "paragraph-places")
    stays = placed.filter("_row = keep_row").groupBy("class").agg(F.min("line").alias("keep_line"))
    return placed.join(stays, "class").filter("_row <> keep_row or line <> keep_line").select("_row", "line", "at", "till", "keep_row")


def repeated_passages(docs: DataFrame, text: str = "text", reach: int = REACH, least_run: int = LEAST_RUN) -> DataFrame:
    """Runs of repeated pieces to remove from stored ``docs``: (_row, piece, at, till, keep_row) of each piece."""
    names = {"_row": "bigint", "piece": "int", "n_words": "int", "at": "bigint", "till": "bigint", "k1": "bigint", "k2": "bigint"}
    kinds = {"bigint": pa.int64(), "int": pa.int32()}

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                found = Paragraphs(*utf8(part.column(text))).pieces(reach)
                yield part, {c: x[found["n_words"] >= SHINGLE] for c, x in found.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in found_in(batches):
            keys, n = np.unique(found["k1"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["k1", "n"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in found_in(batches):
            found["_row"] = part.column("_row").take(pa.array(found["doc"]))
            yield pa.RecordBatch.from_arrays([pa.array(found[c], kinds[t]) if c != "_row" else found[c] for c, t in names.items()], names=list(names))

    # Most pieces stand once: the text is read twice instead of storing them all.
    rows = docs.select("_row", text)
    often = rows.mapInArrow(count, "k1 bigint, n bigint").groupBy("k1").agg(F.sum("n").alias("n")).filter("n > 1").select("k1")
    found = rows.mapInArrow(measure, ", ".join(f"{c} {t}" for c, t in names.items()))
    cut = land(found.join(land(often, "passage-keys"), "k1", "left_semi"), "passage-pieces")
    first = cut.groupBy("k1", "k2").agg(F.min("_row").alias("keep_row"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    known = land(cut.join(first.drop("n"), ["k1", "k2"]), "passage-repeated")
    stays = known.filter("_row = keep_row").groupBy("k1", "k2").agg(F.min("piece").alias("keep_piece"))
    again = known.join(stays, ["k1", "k2"]).filter("_row <> keep_row or piece <> keep_piece")
    # Pieces of one document that follow one another; its pieces are bounded by its length.
    numbered = again.withColumn("_run", F.col("piece") - F.row_number().over(Window.partitionBy("_row").orderBy("piece")))
    long = numbered.withColumn("_words", F.sum("n_words").over(Window.partitionBy("_row", "_run")))
    return long.filter(F.col("_words") >= least_run).select("_row", "piece", "at", "till", "keep_row")


def removals(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """What goes from stored ``docs`` (_row, text): (_row, line or piece, at, till, keep_row); the spans may overlap."""
    lines = duplicate_lines(docs, similarity, text).select("_row", "line", F.lit(None).cast("int").alias("piece"), "at", "till", "keep_row")
    parts = repeated_passages(docs, text).select("_row", F.lit(None).cast("int").alias("line"), "piece", "at", "till", "keep_row")
    return lines.unionByName(parts)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans (first character, the one after the last)."""
    kept, here = [], 0
    for at, till in sorted(spans):
        kept.append(text[here:max(at, here)])
        here = max(here, till)
    return "".join([*kept, text[here:]])


def with_rows(docs: DataFrame, stored: bool) -> DataFrame:
    """Number the rows; a frame that isn't read from files as it stands is stored first."""
    return number_rows(docs) if stored else land(docs.withColumn("_row", F.monotonically_increasing_id()), "paragraph-docs")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", stored: bool = False) -> DataFrame:
    """Take the repeated paragraphs and passages out of the texts; rows left without a word are dropped."""
    rows = with_rows(docs, stored)
    spans = removals(rows.select("_row", text), similarity, text).select("_row", "at", "till").distinct()
    folder, blank = lay_beside(spans, "paragraph-spans"), SPACES.decode()

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(folder)
        for batch in batches:
            many, side = beside.of(batch.column("_row").to_numpy())
            if side is None:
                yield batch
                continue
            held = list(zip(side.column("at").to_pylist(), side.column("till").to_pylist()))
            hit, texts, at = many > 0, batch.column(text), batch.schema.get_field_index(text)
            ends = np.cumsum(many)[hit].tolist()
            left = [_without(t, held[e - m:e]) for t, e, m in zip(texts.filter(pa.array(hit)).to_pylist(), ends, many[hit].tolist())]
            keep = ~hit
            keep[hit] = [bool(t.strip(blank)) for t in left]
            texts = pc.replace_with_mask(texts, pa.array(hit), pa.array(left, texts.type))
            yield batch.set_column(at, batch.schema.field(at), texts).filter(pa.array(keep))

    return rows.mapInArrow(trim, schema_of(rows)).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op4_paragraphs")
def op4_paragraphs(spark, sf_dir):
    """Per document: how many paragraphs and pieces of passages go, which, and the documents that hold the copies that stay."""
    docs = with_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), stored=True)
    gone = land(removals(docs), "paragraph-gone")
    ids = docs.select("_row", "doc_id")
    named = gone.join(ids.select(F.col("_row").alias("keep_row"), F.col("doc_id").alias("kept_in")), "keep_row")
    per = named.groupBy("_row").agg(F.array_sort(F.collect_set("line")).alias("removed_lines"), F.array_sort(F.collect_set("piece")).alias("removed_pieces"),
                                    F.array_sort(F.collect_set("kept_in")).alias("kept_in"))
    none = F.array().cast("array<int>")
    return ids.join(per, "_row", "left").select(
        "doc_id", F.coalesce(F.size("removed_lines") + F.size("removed_pieces"), F.lit(0)).alias("n_removed"),
        F.coalesce("removed_lines", none).alias("removed_lines"), F.coalesce("removed_pieces", none).alias("removed_pieces"),
        F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"))
