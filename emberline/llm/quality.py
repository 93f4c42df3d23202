"""Quality rules by distribution divergence: Jensen-Shannon distance to language references.

Each document's histograms of character classes and of words are compared with the
histograms of every language, summed over the documents that pass the base rules;
the nearest language counts.  The bins of the word histogram are each language's
most frequent words, learned from the table, and one for all other words, so text
that lacks them is as far away as text that is full of one.  Short documents are
guarded: a histogram is judged only above a minimum length, and its limit is widened
by the distance that sampling alone would give.

Defined cases: null text counts as empty and fails the base rules; documents with
null language are judged against all languages, those of a language without a
reference (too little text in the table) by the base rules only; repeated rows are
judged alike; with no reference at all (an empty or wholly rejected table) only the
base rules decide; other columns are kept, but those that have the name of an added
one are replaced by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import SPACES, land, pieces, schema_of, table, utf8
from emberline.llm.registry import query

#: Bytes of text that are measured at once.
PIECE_BYTES = 1 << 20
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Character classes: lower-case ASCII, upper-case ASCII, digit, white space, ``,.``, other ASCII signs, beyond ASCII (lead bytes).
CLASSES = 7
#: Most frequent words of a language that have bins; different words a task counts before it hands its counts on, and rows it hands on at once.
COMMON_WORDS, COUNTED, HANDED_ON = 32, 200_000, 20_000
#: A language needs this many characters in its reference.
REFERENCE_CHARS = 2000
#: Documents nearer than this to a first reference make the second.
TRIM = 0.15
#: Least characters or words for a comparison, limit of the distance, and widening by sqrt(bins / n) / 2.
CHAR_RULE = (200, 0.12, 1.0)
WORD_RULE = (80, 0.15, 0.6)


def _class_table() -> np.ndarray:
    out = np.full(256, 5, np.uint8)
    out[ord("a"):ord("z") + 1], out[ord("A"):ord("Z") + 1], out[ord("0"):ord("9") + 1] = 0, 1, 2
    out[list(SPACES)], out[[ord(","), ord(".")]] = 3, 4
    out[0x80:0xC0], out[0xC0:] = CLASSES, 6      # continuation bytes are dropped
    return out


_CLASS = _class_table()


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, upto = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + 3 - max(upto, i)
            upto = i + 3
    return covered


def learn_words(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = COMMON_WORDS) -> list[str]:
    """The ``most`` most frequent words with a letter of each language, together, from documents with enough words.

    All words are counted: a task that holds too many different ones hands its counts
    on and starts anew, and Spark adds up the counts of all tasks.
    """
    def handed(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for name, own in found.items():
            words = [w for w in own if _has_letter(w)]
            for i in range(0, len(words), HANDED_ON):
                some = words[i:i + HANDED_ON]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.binary()),
                                                  pa.array([own[w] for w in some], pa.int64())], names=["name", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                for name, t in zip(part.column(lang).to_pylist(), part.column(text).cast(pa.binary()).to_pylist()):
                    words = (t or b"").split()
                    if name is None or len(words) < LEAST_WORDS:
                        continue
                    found.setdefault(name, Counter()).update(words)
                    if sum(map(len, found.values())) > COUNTED:
                        yield from handed(found)
                        found = {}
        yield from handed(found)

    sums = docs.select(F.col(lang).cast("string").alias(lang), text).mapInArrow(count, "name string, word binary, n bigint").groupBy("name", "word").agg(F.sum("n").alias("n"))
    # The window keeps ``most`` rows of a language in each task before it meets the others.
    first = sums.withColumn("_place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "word"))).filter(F.col("_place") <= most)
    return sorted({bytes(r["word"]).decode("utf-8", "replace") for r in first.select("word").distinct().collect()})


def _has_letter(word: bytes) -> bool:
    return any(c.isalpha() for c in word.decode("utf-8", "replace"))


def document_counts(docs: DataFrame, common: list[str], text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the histograms _chars, _common (last: other words)."""
    index = {w.encode(): i for i, w in enumerate(common)}
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c not in added and (keep_text or c != text)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
                       + [f"{c} bigint" for c in added] + ["_chars array<int>", "_common array<int>"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, PIECE_BYTES):
                raw, at = utf8(part.column(text))
                whole = raw.tobytes()
                klass = _CLASS[raw]
                n = part.num_rows
                owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
                hist = np.bincount(owner * (CLASSES + 1) + klass, minlength=n * (CLASSES + 1)).reshape(n, -1)[:, :CLASSES]
                out = np.zeros((n, 5), np.int64)
                out[:, 1] = hist.sum(1) - hist[:, 3]
                words_hist = np.zeros((n, len(common) + 1), np.int32)
                for i in range(n):
                    t = whole[at[i]:at[i + 1]]
                    words = t.split()
                    out[i, 0] = len(words)
                    out[i, 2] = len(t) - len(t.translate(None, SYMBOLS))
                    lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                    out[i, 3] = len(lines) - len(set(lines))
                    out[i, 4] = _repeated(words)
                    found = Counter(map(index.get, words))
                    found.pop(None, None)
                    if found:
                        words_hist[i, list(found)] = list(found.values())
                    words_hist[i, -1] = len(words) - words_hist[i].sum()
                arrays = [part.column(c) for c in kept] + [pa.array(out[:, j]) for j in range(5)]
                arrays += [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]),
                                                    pa.array(m.astype(np.int32).ravel())) for m in (hist, words_hist)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added, "_chars", "_common"])

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])]).mapInArrow(measure, schema)


def _matrix(column: pa.Array, bins: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, bins).astype(np.float64)


def references(counted: DataFrame, bins: dict[str, int], lang: str = "lang") -> dict[str, list]:
    """Histograms summed over the rows of each language, and the languages' ``names``: a few numbers per language, added up per partition first."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            langs = batch.column("ref").dictionary_encode()
            codes = langs.indices.to_numpy()
            for kind, n in bins.items():
                h = _matrix(batch.column(kind), n)
                for i, name in enumerate(langs.dictionary.to_pylist()):
                    found[name, kind] = found.get((name, kind), 0) + h[codes == i].sum(0)
        flat = [(k[0], k[1], i, float(v)) for k, h in found.items() for i, v in enumerate(h)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], t) for j, t in enumerate(
            (pa.string(), pa.string(), pa.int32(), pa.float64()))], names=["ref", "kind", "bin", "n"])

    parts = (counted.filter(F.col(lang).isNotNull() & ~F.col("base_failed")).select(F.col(lang).cast("string").alias("ref"), *bins)
             .mapInArrow(sums, "ref string, kind string, bin int, n double"))
    out: dict[str, list] = {**{k: [] for k in bins}, "names": []}
    whole = {(r["ref"], r["kind"], r["bin"]): r["n"]
             for r in parts.groupBy("ref", "kind", "bin").agg(F.sum("n").alias("n")).collect()}
    for ref in sorted({k[0] for k in whole}):
        hists = {kind: np.array([whole[ref, kind, i] for i in range(n)]) for kind, n in bins.items()}
        if hists["_chars"].sum() >= REFERENCE_CHARS:
            out["names"].append(ref)
            for kind, h in hists.items():
                if h.sum() > 0:
                    out[kind].append(h)
    return out


def js_distance(counts: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts to one reference; NaN for an empty row."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / counts.sum(1, keepdims=True)
        q = ref / ref.sum()
        m = (p + q) / 2
        terms = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
        return np.where(counts.sum(1) > 0, np.sqrt(np.maximum(terms, 0) / 2), np.nan)


def with_distances(counted: DataFrame, refs: dict[str, list[np.ndarray]], bins: dict[str, int]) -> DataFrame:
    """Add char_distance and word_distance: to the nearest reference, null if the row or every reference is empty."""
    names = {"char_distance": "_chars", "word_distance": "_common"}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            for own in names.values():
                h = _matrix(batch.column(own), bins[own])
                near = [js_distance(h, r) for r in refs[own]]
                arrays.append(pa.array(np.min(near, axis=0) if near else np.full(len(h), np.nan), from_pandas=True))
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])

    return counted.mapInArrow(measure, schema_of(counted, *[f"{n} double" for n in names]))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", common: list[str] | None = None,
          char_rule=CHAR_RULE, word_rule=WORD_RULE, keep_text: bool = True) -> DataFrame:
    """Add the counts, base_failed, char_distance, word_distance and kept to every row.

    What is collected is one pair of histograms per language label.
    """
    common = learn_words(docs, text, lang) if common is None else common
    counted = document_counts(docs, common, text, keep_text).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    counted = land(counted, "quality-counts")
    bins = {"_chars": CLASSES, "_common": len(common) + 1}
    # The first references hold junk too; the second are learned from what is near the first.
    narrow = counted.select(lang, "base_failed", *bins)
    first = with_distances(narrow, references(narrow, bins, lang), bins)
    refs = references(first.filter(F.col("char_distance") <= TRIM), bins, lang)

    def over(distance: str, n: Column, of: int, rule) -> Column:
        least, limit, widen = rule
        return F.coalesce((n >= least) & (F.col(distance) > limit + widen * F.sqrt(of / (n + 1.0)) / 2), F.lit(False))

    chars = F.aggregate("_chars", F.lit(0), lambda a, x: a + x)
    bad = over("char_distance", chars, CLASSES, char_rule) | over("word_distance", F.col("n_words"), len(common) + 1, word_rule)
    judged = F.col(lang).isNull() | F.col(lang).cast("string").isin(refs["names"])          # a language without a reference isn't judged by others
    return with_distances(counted, refs, bins).withColumn("kept", ~F.col("base_failed") & ~(bad & judged)).drop("_chars", "_common")


@query("op1_divergence")
def op1_divergence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                              "kept", "char_distance", "word_distance")
