"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 16 four-bit segments.
The Manhattan distance of two such vectors never exceeds the Hamming distance of
the fingerprints, so linked fingerprints (two or fewer differing bits) have
vectors at distance two or less, and these share a grid point at distance one or
less from both: each fingerprint visits its own point and the at most 32 points
next to it, points are joined by equality, and pairs are verified on the bits
inside the join.  The grid point through which a pair is reported is fixed by the
pair, so every link comes out once.  Equal fingerprints are collapsed before.

Defined cases: null or empty text has fingerprint zero and is linked like any
other; null ids take part in links and are never a component's id unless it has
no other (then null); repeated rows have one fingerprint; an empty table gives an
empty result; other columns are kept where rows are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from emberline.llm import paragraphs
from emberline.llm.common import keep_beside, land, link_groups, pieces, schema_of, table, utf8
from emberline.llm.registry import query
from emberline.operators.clusters import components

SHINGLE, SEED, LINK_BITS = 3, 42, 2
#: What the pipeline's stage links besides op2's fingerprints, by Jaccard of five-word shingles.
SIMILARITY = 0.8
#: Byte value -> eight byte lanes holding its bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def _bit_counts(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Set bits per position of each document's hashes; 255 hashes at most add up in a byte lane at once."""
    out = np.zeros((len(ends), 64), np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    has = np.flatnonzero(ends > starts)
    if not len(has):
        return out
    blocks = -(-(ends - starts)[has] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    at = np.repeat(starts[has], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    by = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[by[:, k]], at).view(np.uint8).reshape(-1, 8)
        out[has, 8 * k:8 * k + 8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    return out


def fingerprints(docs: DataFrame, text: str = "text", words: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """Add ``_fp``, the SimHash of the whole text's word shingles, as a signed long."""
    kept = docs if keep_text else docs.drop(text)
    names = kept.columns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                raw, at = utf8(part.column(text))
                whole = raw.tobytes().lower()
                found, ends = [], np.zeros(part.num_rows, np.int64)
                for i in range(part.num_rows):
                    tokens = whole[at[i]:at[i + 1]].split()
                    if len(tokens) >= words:
                        grams = map(b" ".join, zip(*[tokens[j:] for j in range(words)]))
                        found.extend(map(xxh64_intdigest, grams, repeat(SEED)))
                    elif tokens:
                        found.append(xxh64_intdigest(b" ".join(tokens), SEED))
                    ends[i] = len(found)
                counts = _bit_counts(np.array(found, np.uint64), ends)
                n = np.diff(ends, prepend=0)
                bits = np.packbits((2 * counts > n[:, None]), axis=1, bitorder="little")
                fp = bits.copy().view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(fp)], names=[*names, "_fp"])

    return docs.mapInArrow(measure, schema_of(kept, "_fp bigint"))


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 16 four-bit segments, packed four bits each."""
    even, odd = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    a, b = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    pairs = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))       # a sum without carry into the sign
    return pairs.bitwiseAND(odd) + F.shiftrightunsigned(pairs, 2).bitwiseAND(odd)


def links(prints: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in at most ``bits`` (two at most) bits, each once.

    The grid has up to 33 rows for each fingerprint, which Catalyst doesn't see in the size of
    their files: its sides are merged, never broadcast.
    """
    if bits > 2:
        raise ValueError("the grid covers differences of up to two bits")
    # step 0: the own point; +-i: one more or one less in segment i
    grid = prints.select(F.col("_fp"), segment_counts(F.col("_fp")).alias("_p")).select(
        "_fp", "_p", F.explode(F.sequence(F.lit(-16), F.lit(16))).alias("_step"))
    held = F.expr("(shiftrightunsigned(_p, 4 * greatest(abs(_step) - 1, 0))) & 15")
    move = F.expr("case when _step > 0 then shiftleft(1L, 4 * (_step - 1)) when _step < 0 then -shiftleft(1L, 4 * (-_step - 1)) else 0L end")
    grid = (grid.filter((F.col("_step") == 0) | ((F.col("_step") > 0) & (held < 4)) | ((F.col("_step") < 0) & (held > 0)))
            .select((F.col("_p") + move).alias("_point"), "_step", "_fp"))
    a, b = grid.alias("a"), grid.alias("b")
    once = F.expr("abs(a._step) <= abs(b._step) and (a._step = 0 or a._step <> b._step)")
    near = F.expr(f"a._fp < b._fp and bit_count(a._fp ^ b._fp) <= {bits}")
    return a.join(b.hint("merge"), (F.col("a._point") == F.col("b._point")) & near & once).select(F.col("a._fp").alias("a"), F.col("b._fp").alias("b"))


def print_roots(printed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(_fp, _first, _root) for every distinct fingerprint of a stored table (id_col, _fp): its smallest id, its component's fingerprint."""
    groups = land(printed.groupBy("_fp").agg(F.min(id_col).alias("_first")), "simhash-groups")
    roots = components(land(links(groups), "simhash-links"))
    return groups.join(roots, F.col("_fp") == F.col("node"), "left").select(
        "_fp", "_first", F.coalesce("component", "_fp").alias("_root"))


def component_ids(printed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(_fp, component_id) for every distinct fingerprint of a stored table (id_col, _fp)."""
    rooted = print_roots(printed, id_col)
    mins = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return rooted.join(mins, "_root").select("_fp", "component_id")


def printed_groups(rows: DataFrame, text: str = "text") -> DataFrame:
    """(_row, group) of stored ``rows`` (_row, text): components of linked fingerprints, named by their first row."""
    printed = land(fingerprints(rows.select("_row", text), text, keep_text=False), "neardup-prints")
    rooted = print_roots(printed, "_row")
    named = rooted.join(rooted.groupBy("_root").agg(F.min("_first").alias("group")), "_root")
    return printed.join(named.select("_fp", "group"), "_fp").select("_row", "group")


def joined_groups(one: DataFrame, other: DataFrame) -> DataFrame:
    """(_row, group) of two groupings (_row, group) of the same rows: rows that meet in either are together.

    A group of either is named by its first row here, so a row links the names of its two groups.
    """
    def named(groups: DataFrame, name: str) -> DataFrame:
        first = groups.groupBy("group").agg(F.min("_row").alias(name))
        return groups.join(first, "group").select("_row", name)

    both = land(named(one, "a").join(named(other, "b"), "_row"), "neardup-both")
    roots = link_groups(both.select("a", "b"))
    return both.join(roots, F.col("a") == F.col("node"), "left").select("_row", F.coalesce("component", "a").alias("group"))


def similar_groups(rows: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """(_row, group) of stored ``rows`` (_row, text): components of texts whose sets of five-word shingles are that similar.

    Each text is one paragraph of ``paragraphs``: candidates from its MinHash bands
    and its exact prefix filter, links by exact Jaccard.  Texts of under five words
    have one shingle, so only equal ones are linked; those without a word are one group.
    """
    flat = rows.select("_row", F.translate(text, "\n", " ").alias(text))
    found = land(paragraphs.paragraph_bands(flat, text, 1), "neardup-bands")
    reps = found.groupBy("k1", "k2").agg(F.min("_row").alias("first_row"), F.count(F.lit(1)).alias("copies"), F.min("n_words").alias("n_words"),
                                         *[F.min(f"b{i}").alias(f"b{i}") for i in range(paragraphs.BANDS)])
    reps = land(reps.withColumn("pid", F.monotonically_increasing_id()), "neardup-reps")
    longer = reps.filter(F.col("n_words") >= paragraphs.SHINGLE)
    roots = link_groups(land(paragraphs.similar_links(flat, longer, similarity, text, 1), "neardup-links"))
    named = reps.select("pid", "k1", "k2").join(roots, F.col("pid") == F.col("node"), "left")
    named = named.select("k1", "k2", F.coalesce("component", "pid").alias("group"))
    worded = found.select("_row", "k1", "k2").join(named, ["k1", "k2"]).select("_row", "group")
    return rows.select("_row").join(worded, "_row", "left").select("_row", F.coalesce("group", F.lit(-1)).alias("group"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", id_col: str = "doc_id",
                stored: bool = False) -> DataFrame:
    """Keep one row of each group of similar texts: the one with the smallest id (of repeated rows, the first).

    Texts are linked by their fingerprints, and by exact similarity where these differ in more bits.  A frame that is read from files as it stands (``stored``) isn't written again.
    """
    rows = paragraphs.with_rows(docs, stored)
    placed = rows.select(F.col(f"`{id_col}`").alias("_id"), "_row").join(
        joined_groups(printed_groups(rows, text), similar_groups(rows, similarity, text)), "_row")
    # A null id is the least wanted.
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first"))
    return keep_beside(rows, first.select(F.col("first._row").alias("_row")), "neardup-kept").select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    printed = land(fingerprints(docs, keep_text=False), "simhash-docs")
    return printed.join(component_ids(printed), "_fp").select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
