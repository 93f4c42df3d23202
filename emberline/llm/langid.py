"""Language identification by cross-parsing entropy.

The suffix automaton of a language's labelled text reads a document and cuts it
into phrases, each the longest match with that text; the language that needs the
fewest phrases per symbol wins.  Automata are built from a bounded sample of the
training rows and kept as transition tables; a batch of documents is read in
lockstep, cut into blocks of ``BLOCK`` symbols that are parsed side by side (a cut
may add one phrase, alike for every language).  Whole texts are read.

Defined cases: null text or text without a letter is ``und`` with score 0, and so
is everything if no language could be learned; ties go to the first language in
code-point order; repeated rows are scored alike; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import held_out, pieces, table
from emberline.llm.registry import query

#: Bounds of the training sample, per language: documents read, symbols of each, symbols in all; letters told apart.
SAMPLE_DOCS, SAMPLE_EACH, SAMPLE_SYMBOLS, LETTERS = 120, 400, 20_000, 200
BLOCK = 256
UNKNOWN = "und"
_GAP, _OTHER = 0, 1          # symbols: no letter; a letter that the sample hasn't


def letter_table(letters: str) -> np.ndarray:
    """Code point -> symbol: 0 no letter, 1 another letter, 2 and on the sample's lower-case letters."""
    out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    for i, c in enumerate(letters):
        out[ord(c)] = i + 2
        up = c.upper()
        if len(up) == 1:
            out[ord(up)] = i + 2
    return out


def symbols(texts: list[str], table_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with runs of gaps made one, each text's number of them, and of its letters."""
    ends = np.cumsum([len(t) for t in texts])
    code = table_[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    letters = np.bincount(owner[code != _GAP], minlength=len(texts))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != _GAP) | (code[:-1] != _GAP) | (owner[1:] != owner[:-1])
    return code[keep], np.bincount(owner[keep], minlength=len(texts)), letters


def suffix_automaton(word: list[int], n_symbols: int) -> np.ndarray:
    """Transition table (state * n_symbols + symbol -> state, -1 for none); state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in word:
        state = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    out = np.full((len(nexts), n_symbols), -1, np.int32)
    for s, to in enumerate(nexts):
        out[s, list(to)] = list(to.values())
    return out


def phrases(blocks: np.ndarray, automaton: np.ndarray) -> np.ndarray:
    """Longest-match phrases of each column; the last symbol of the table is padding."""
    n = automaton.shape[1]
    flat, root = automaton.ravel(), np.maximum(automaton[0], 0)
    state, count = np.zeros(blocks.shape[1], np.int64), np.zeros(blocks.shape[1], np.int64)
    for row in blocks:
        to = flat[state * n + row]
        miss = to < 0
        count += miss
        state = np.where(miss, root[row], to)
    return count


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> tuple[str, dict[str, np.ndarray]]:
    """Letters and automata from labelled rows; what comes to the driver is bounded by the sample's parameters."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # One count per language, as the model holds one automaton per language; the scan then picks its rows without a join.
    counts = {r[lang]: r["_n"] for r in known.groupBy(lang).agg(F.count(F.lit(1)).alias("_n")).collect()}
    if not counts:
        return "", {}
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in sorted(counts.items()) for x in (name, (1 << 20) * SAMPLE_DOCS / n)]),
                         F.col(lang))
    picked = (known.filter(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 20)) < share)
              .select(lang, F.substring(text, 1, 4 * SAMPLE_EACH).alias(text), F.xxhash64(id_col).alias("_key")))
    texts: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r[lang], r["_key"], r[text])):
        texts.setdefault(r[lang], []).append("".join(c if c.isalpha() else " " for c in r[text].lower())[:2 * SAMPLE_EACH])
    tally: dict[str, int] = {}
    for own in texts.values():
        for c in "".join(own):
            if c != " " and c.isalpha() and len(c.upper()) == 1:
                tally[c] = tally.get(c, 0) + 1
    letters = "".join(sorted(sorted(tally, key=lambda c: (-tally[c], c))[:LETTERS]))
    codes = letter_table(letters)
    automata = {}
    for name in sorted(texts):
        seq, sizes, found = symbols(texts[name], codes)
        if not found.sum():
            continue
        word: list[int] = []
        for own in np.split(seq, np.cumsum(sizes)[:-1]):
            word += [_GAP, *own[:SAMPLE_EACH].tolist()]
            if len(word) >= SAMPLE_SYMBOLS:
                break
        automaton = suffix_automaton(word, len(letters) + 3)
        automaton[:, _OTHER] = -1
        automaton[:, -1] = np.arange(len(automaton))      # padding stays and is no phrase
        automata[name] = automaton
    return letters, automata


def identify(docs: DataFrame, letters: str, automata: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Replace the text by lang_pred and score: 1 - phrases of the best language / phrases of the next."""
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    names = sorted(automata)
    shared = docs.sparkSession.sparkContext.broadcast((letters, [automata[n] for n in names]))   # bounded by the sample

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, tables = shared.value
        codes = letter_table(alphabet)
        pad = len(alphabet) + 2
        for batch in batches:
            for part in pieces(batch, text):
                seq, sizes, found = symbols(part.column(text).fill_null("").to_pylist(), codes)
                per = -(-sizes // BLOCK)
                first = np.cumsum(per) - per
                starts = np.cumsum(sizes) - sizes
                blocks = np.full((int(per.sum()), BLOCK), pad, np.uint8 if pad < 256 else np.int16)
                spot = np.arange(len(seq)) - np.repeat(starts, sizes)
                blocks.ravel()[np.repeat(first * BLOCK, sizes) + spot] = seq
                columns = np.ascontiguousarray(blocks.T)
                owner = np.repeat(np.arange(len(sizes)), per)
                needed = np.array([np.bincount(owner, phrases(columns, t), len(sizes)) for t in tables]).reshape(len(tables), -1)
                ok = (found > 0) & bool(names)
                if names:
                    best = needed.argmin(0)
                    ranked = np.sort(needed, 0)
                    score = 1 - ranked[0] / np.maximum(ranked[1], 1) if len(names) > 1 else np.ones(len(sizes))
                    pred = [names[b] if o else UNKNOWN for b, o in zip(best.tolist(), ok.tolist())]
                else:
                    score, pred = np.zeros(len(sizes)), [UNKNOWN] * len(sizes)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(pred, pa.string()),
                                                  pa.array(np.where(ok, np.clip(score, 0, 1), 0.0))], names=[*kept, "lang_pred", "score"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept],
                        "lang_pred string", "score double"])
    return docs.select(*[f"`{c}`" for c in kept], text).mapInArrow(measure, schema)


@query("op3_cross_parsing")
def op3_cross_parsing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    letters, automata = learn(docs.filter("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), letters, automata)
