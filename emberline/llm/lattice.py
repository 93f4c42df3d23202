"""Language-model score of texts: the marginal probability over all segmentations into pieces of an existing vocabulary.

A text is its lower-cased words and one end.  A word is a start mark and its bytes;
every path of vocabulary pieces through it is a segmentation, and the word's
probability is the sum over all of them, computed by the forward recursion in log
space (no best path is picked).  Single bytes are pieces too, so every word has a
path.  No piece crosses a word, so a text's log probability is the sum over its
words and its end.

The vocabulary file ranks its pieces by its own scores.  These give the first
weights (Zipf's law over the ranks), and the expected counts of the pieces over all
segmentations of all different training words refine them for ``ROUNDS`` rounds; the
first weights stay in as a small prior.  Pieces with ASCII capitals can't occur and
have no weight.  A word that training texts hold has one more edge, the whole word,
weighted with its count less a discount; the discounts of all words are the share of
the paths through pieces.  All this is a probability distribution over words and end.
A text may further come from one of a few classes of training texts (``class_col``,
say their language), whose words are counted apart and fall back on those of all
texts in the same way; its class is not looked at, the score sums over all classes.

In Spark: words are counted once for all (a row for each different word, which is
what grows with the corpus), each round sums expected counts inside its tasks into
one array of the vocabulary's size, and every different word is scored once.  Then
texts meet their words: words that make up at least one in ``HOT_SHARE`` of all
tokens are at most ``HOT_SHARE`` many, whatever the input, and are looked up beside
the scan; all other words are shuffled by word.  No shuffled word can be hot, as
frequent ones never are.

Defined cases: null and empty texts hold the end only; repeated rows and null ids
are scored row by row, a null id is never held out; the mark for the start of a
word inside a word is spelled in bytes; texts of null or rarer classes than the
``CLASSES`` most frequent ones (ties: the smaller name) count for all texts only;
without training tokens every piece has its first weight and the base falls back to
its constant; an empty table gives an empty result.  Other columns are not carried
along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import IS_SPACE, land, pieces, table, utf8
from emberline.llm.registry import query

VOCABULARY = "piece_bpe_32k.model"
#: Rounds of re-estimation; weight of the first weights, as a share of the pieces counted; frequent words are at least 1 in HOT_SHARE tokens;
#: classes told apart.
ROUNDS, PRIOR, HOT_SHARE, CLASSES = 4, 0.002, 250_000, 8
#: Additive smoothing of the word base.
ADDED = 0.1
#: Words gathered for one pass of the recursion, and places of one matrix.
WORDS_AT_ONCE, MATRIX = 1 << 16, 1 << 21
MARK = b"\xff"          # in no UTF-8 text
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


class Vocabulary:
    """The pieces that lower-cased words can hold, in the order of their scores, as a byte trie in two tables."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        spelled: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                spelled.setdefault(bytes([int(piece[3:5], 16)]), model.get_score(i))
                continue
            raw = (MARK if piece.startswith("▁") else b"") + piece.removeprefix("▁").encode()
            if "▁" in piece[1:] or any(65 <= b <= 90 or IS_SPACE[b] for b in raw):
                continue
            spelled[raw] = max(spelled.get(raw, -np.inf), model.get_score(i))
        self.pieces = sorted(spelled, key=lambda p: (-spelled[p], p))
        self._grow()

    def _grow(self) -> None:
        nodes, piece_of = [{}], [-1]
        for i, piece in enumerate(self.pieces):
            at = 0
            for b in piece:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                    piece_of.append(-1)
                at = nodes[at][b]
            piece_of[at] = i
        used = sorted({b for n in nodes for b in n})
        self.kind = np.full(256, len(used), np.int64)           # the last column leads nowhere
        self.kind[used] = np.arange(len(used))
        inner = [i for i, n in enumerate(nodes) if n]
        self.row = np.full(len(nodes), len(inner), np.int32)    # nor does the last row
        self.row[inner] = np.arange(len(inner))
        self.child = np.zeros((len(inner) + 1, len(used) + 1), np.int32)
        for r, i in enumerate(inner):
            for b, to in nodes[i].items():
                self.child[r, self.kind[b]] = to
        self.piece_of = np.array(piece_of, np.int32)

    def zipf(self) -> np.ndarray:
        """First weights: shares of the pieces by rank."""
        share = 1 / (np.arange(len(self.pieces)) + 2.7)
        return share / share.sum()


def _lattice(vocabulary: Vocabulary, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, which words, which pieces) of the edges of equally long words, by start."""
    kinds = vocabulary.kind[words]
    for start in range(words.shape[1]):
        who = np.arange(len(words))
        node = np.zeros(len(words), np.int32)
        for stop in range(start, words.shape[1]):
            node = vocabulary.child[vocabulary.row[node], kinds[who, stop]]
            on = node > 0
            if not on.all():
                who, node = who[on], node[on]
                if not len(who):
                    break
            piece = vocabulary.piece_of[node]
            ends = piece >= 0
            if ends.any():
                yield start, stop + 1, who[ends], piece[ends]


def _same_length(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their bytes after the mark as a matrix), words of one length at a time."""
    size = np.diff(at)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        n = int(size[group[0]])
        step = max(1, MATRIX // (n + 1))
        for i in range(0, len(group), step):
            own = group[i:i + step]
            body = raw[at[own][:, None] + np.arange(n)] if n else np.zeros((len(own), 0), np.uint8)
            yield own, np.concatenate([np.full((len(own), 1), MARK[0], np.uint8), body], 1)


def marginals(vocabulary: Vocabulary, logs: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of the summed probability of all segmentations of each word: forward recursion in log space."""
    out = np.empty(len(at) - 1)
    for own, words in _same_length(raw, at):
        forward = np.full((words.shape[1] + 1, len(own)), -np.inf)
        forward[0] = 0
        for start, stop, who, piece in _lattice(vocabulary, words):
            forward[stop, who] = np.logaddexp(forward[stop, who], forward[start, who] + logs[piece])
        out[own] = forward[-1]
    return out


def expected(vocabulary: Vocabulary, logs: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of each of the words."""
    total = np.zeros(len(vocabulary.pieces))
    for own, words in _same_length(raw, at):
        edges = list(_lattice(vocabulary, words))
        forward = np.full((words.shape[1] + 1, len(own)), -np.inf)
        backward = forward.copy()
        forward[0] = backward[-1] = 0
        for start, stop, who, piece in edges:
            forward[stop, who] = np.logaddexp(forward[stop, who], forward[start, who] + logs[piece])
        for start, stop, who, piece in reversed(edges):
            through = logs[piece] + backward[stop, who]
            share = np.exp(forward[start, who] + through - forward[-1, who])
            total += np.bincount(piece, share, len(total))
            backward[start, who] = np.logaddexp(backward[start, who], through)
    return total


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words end to end, their n + 1 offsets, text number of each word, words of each text)."""
    raw, at = utf8(column)
    inside = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(first)
    owner = np.searchsorted(at, start, "right") - 1
    begins = np.cumsum(inside)                                  # places among the bytes that stay
    offsets = np.append(begins[start] - 1, inside.sum()).astype(np.int64)
    return _FOLD[raw[inside]], offsets, owner, np.bincount(owner, minlength=len(column))


def as_words(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


def count_words(docs: DataFrame, classes: int = 0, text: str = "text") -> DataFrame:
    """word, trained, n, c0, c1 ...: occurrences in texts to learn from, in all, in each class; summed in pieces of text first.

    ``docs`` has a column ``part``: a class, ``classes`` for texts without one, -1 for texts held out.
    """
    names = ["trained", "n", *[f"c{k}" for k in range(classes)]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, 8 << 20):
                raw, at, owner, _ = tokens(part.column(text))
                code = as_words(raw, at).dictionary_encode()
                kind, width = code.indices.to_numpy(zero_copy_only=False), len(code.dictionary)
                own = part.column("part").to_numpy()[owner]
                sums = [np.bincount(kind[own >= 0], minlength=width), np.bincount(kind, minlength=width),
                        *[np.bincount(kind[own == k], minlength=width) for k in range(classes)]]
                yield pa.RecordBatch.from_arrays([code.dictionary.cast(pa.binary()), *[pa.array(x.astype(np.int64)) for x in sums]],
                                                 names=["word", *names])

    schema = ", ".join(["word binary", *[f"{c} bigint" for c in names]])
    found = docs.select(F.col(text).alias(text), "part").mapInArrow(count, schema)
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= WORDS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bytes_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Words are any bytes here, so they are not read as text."""
    own = t.column("word").combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    own = own.cast(pa.large_binary())
    _, offsets, data = own.buffers()
    at = np.frombuffer(offsets, np.int64)[own.offset:own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def learn(words: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Natural logs of the weights of all pieces, from stored counts (word, trained)."""
    first = vocabulary.zipf()
    weights = first
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((vocabulary, np.log(weights)))           # bounded by the vocabulary

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, logs = shared.value
            total = np.zeros(len(own.pieces))
            for t in _gathered(batches):
                total += expected(own, logs, *_bytes_of(t))
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["piece", "n"])

        counts = np.zeros(len(first))
        for r in words.filter("trained > 0").select("word").mapInArrow(count, "piece int, n double").groupBy("piece").agg(
                F.sum("n").alias("n")).collect():                           # at most a row for each piece
            counts[r["piece"]] = r["n"]
        shared.unpersist()
        if not counts.any():
            break
        weights = counts + prior * counts.sum() * first
        weights = weights / weights.sum()
    return np.log(weights)


class Mixture:
    """Word weights of all texts and of each class: counted words less a discount, the rest by the lattice or by all texts."""

    def __init__(self, texts: list[int], tokens: list[int], kinds: list[int], once: int, twice: int):
        """``texts``, ``tokens`` (ends included) and different words: of all training texts, then of each class."""
        self.texts, self.tokens, self.kinds = texts, tokens, kinds
        self.discount = once / (once + 2 * twice) if once else 0.5
        other = texts[0] - sum(texts[1:])
        #: log10 of the share of each class, and of the probability of the end in each.
        self.shares = [float(np.log10((n + (i == 0)) / (texts[0] + 1))) if n + (i == 0) else -np.inf for i, n in enumerate([other, *texts[1:]])]
        self.ends = [float(np.log10((n + 0.5) / (all_ + 1))) for n, all_ in zip(texts, tokens)]

    def base(self, counts):
        return np.log10((counts + ADDED) / (self.tokens[0] + ADDED * (self.kinds[0] + (self.texts[0] > 0) + 1)))

    def of(self, which: int, counts: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Natural logs of words counted ``counts`` times, with natural logs ``rest`` where the discounts go."""
        with np.errstate(divide="ignore"):
            counted = np.log(np.maximum(counts - self.discount, 0))
        return np.logaddexp(counted, np.log(self.discount * self.kinds[which] + 0.5) + rest) - np.log(self.tokens[which] + 1)


def with_scores(words: DataFrame, vocabulary: Vocabulary, logs: np.ndarray, model: Mixture) -> DataFrame:
    """word, n, known, base, p0 (all texts), p1 ...: log10 of what each word adds to a text's scores."""
    shared = words.sparkSession.sparkContext.broadcast((vocabulary, logs))
    names = [f"p{k}" for k in range(len(model.texts))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        for t in _gathered(batches):
            trained = t.column("trained").to_numpy()
            found = [model.of(0, trained, marginals(own, weights, *_bytes_of(t)))]
            found += [model.of(k, t.column(f"c{k - 1}").to_numpy(), found[0]) for k in range(1, len(names))]
            yield from pa.table([t.column("word"), t.column("n"), pa.array((trained > 0).astype(np.int64)), pa.array(model.base(trained)),
                                 *[pa.array(x / np.log(10)) for x in found]], names=["word", "n", "known", "base", *names]).to_batches()

    return words.mapInArrow(measure, ", ".join(["word binary, n bigint, known bigint, base double", *[f"{c} double" for c in names]]))


def look_up(docs: DataFrame, frequent: list, sums: list[str], id_col: str, text: str) -> DataFrame:
    """One row a text: id, held_out, n_tokens (without the end), sums over its frequent words, and its other words with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(                      # at most HOT_SHARE words
        (pa.array([bytes(r["word"]) for r in frequent], pa.large_binary()), [np.array([r[c] for r in frequent], np.float64) for c in sums]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, values = shared.value
        for batch in batches:
            for part in pieces(batch, text, 4 << 20):
                raw, at, owner, many = tokens(part.column(text))
                code = as_words(raw, at).dictionary_encode()
                kinds, width = code.indices.to_numpy(zero_copy_only=False), len(code.dictionary) + 1
                spot = pc.fill_null(pc.index_in(code.dictionary, value_set=hot), -1).to_numpy()[kinds] if len(kinds) else kinds
                seen = spot >= 0
                total = [np.bincount(owner[seen], x[spot[seen]], part.num_rows).astype(np.float64) for x in values]     # of nothing: ints
                pair, times = np.unique(owner[~seen].astype(np.int64) * width + kinds[~seen], return_counts=True)
                offsets = pa.array(np.searchsorted(pair // width, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), part.column("held_out"), pa.array(many.astype(np.int64)), *map(pa.array, total),
                     pa.ListArray.from_arrays(offsets, code.dictionary.take(pa.array(pair % width)).cast(pa.binary())),
                     pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
                    names=[id_col, "held_out", "n_tokens", *sums, "words", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}, held_out boolean, n_tokens bigint", *[f"{c} double" for c in sums], "words array<binary>, times array<bigint>"])
    return docs.select(id_col, F.col(text).alias(text), "held_out").mapInArrow(measure, schema)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", class_col: str | None = None, vocabulary: str | None = None,
                rounds: int = ROUNDS, hot_share: int = HOT_SHARE, most_classes: int = CLASSES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (id, text, held_out)."""
    pieces_of = Vocabulary(vocabulary or public_tokenizers.path(VOCABULARY))
    named = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    learned = docs.filter("not held_out")
    texts = learned.count()
    largest = learned.select(named.alias("name")).filter("name is not null").groupBy("name").count().orderBy(F.desc("count"), "name").limit(most_classes).collect()
    part = F.when(F.col("held_out"), -1)
    for k, r in enumerate(largest):
        part = part.when(named == r["name"], k)
    docs = docs.select(id_col, F.col(text), "held_out", part.otherwise(len(largest)).alias("part"))

    counts = land(count_words(docs, len(largest), text), "lattice-counts")
    each = ["trained", *[f"c{k}" for k in range(len(largest))]]
    found = counts.agg(F.sum("n").alias("n"), F.count(F.when(F.col("trained") == 1, 1)).alias("once"), F.count(F.when(F.col("trained") == 2, 1)).alias("twice"),
                       *[F.sum(c).alias(f"{c}_sum") for c in each], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in each]).first()
    texts_of = [texts, *[r["count"] for r in largest]]
    model = Mixture(texts_of, [(found[f"{c}_sum"] or 0) + n for c, n in zip(each, texts_of)], [found[f"{c}_kinds"] for c in each], found["once"], found["twice"])

    words = land(with_scores(counts, pieces_of, learn(counts, pieces_of, rounds), model), "lattice-words")
    hot = F.col("n") >= max(1, -(-(found["n"] or 0) // hot_share))
    scores = [f"p{k}" for k in range(len(texts_of))]
    sums = ["known", "base", *scores]
    frequent = words.filter(hot).collect()                                                  # at most ``hot_share`` words
    rows = land(look_up(docs, frequent, sums, id_col, text).withColumn("_row", F.monotonically_increasing_id()), "lattice-texts")
    rare = rows.select("_row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("_row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(words.filter(~hot).drop("n"), "word").groupBy("_row").agg(*[F.sum(F.col("times") * F.col(c)).alias(f"r_{c}") for c in sums])
    total = {c: F.col(c) + F.coalesce(f"r_{c}", F.lit(0.0)) for c in sums}
    by_class = [total[c] + (end + share) for c, end, share in zip(scores, model.ends, model.shares)]
    best = F.greatest(*by_class) if len(by_class) > 1 else by_class[0]
    return rows.drop("words", "times").join(met, "_row", "left").select(
        id_col, "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (total["known"].cast("long") + int(texts > 0)).alias("n_known"),
        F.lit(model.tokens[0]).cast("long").alias("train_tokens"), (total["base"] + float(model.base(texts))).alias("base_score"),
        (best + F.log10(sum((F.pow(F.lit(10.0), c - best) for c in by_class[1:]), F.pow(F.lit(10.0), by_class[0] - best)))).alias("score"))


@query("op13_lattice")
def op13_lattice(spark, sf_dir):
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0"), F.lit(False))
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held), class_col="lang")
