"""Vector codes, importance resampling and lattice scores against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emberline.llm import codebooks, importance, lattice

NAN, INF = float("nan"), float("inf")


# --- vector codes

def plain_codes(rows, positions=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error) of each usable row and the codebooks, by loops over unbounded integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    lengths = Counter(len(r[1]) for r in kept)
    length = min(lengths, key=lambda n: (-lengths[n], n))
    ints = [[math.floor(x * scale) if abs(x) < 2.0 ** 60 else int(x) * scale for x in r[1]] for r in kept]
    width = -(-length // positions)
    cut = [None if len(v) != length else [(v + [0] * width * positions)[p * width:(p + 1) * width] for p in range(positions)] for v in ints]
    used = [c for c in cut if c]
    books = [[c[p] for c in used[:entries]] for p in range(positions)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))                     # noqa: E731
    near = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))          # noqa: E731
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [near(c[p], book) for c in used]
            books[p] = [[sum(c[p][j] for c, o in zip(used, own) if o == e) // own.count(e) for j in range(width)] if e in own else book[e]
                        for e in range(len(book))]
    out = []
    for r, c in zip(kept, cut):
        at = [near(c[p], books[p]) for p in range(positions)] if c else None
        error = sum(far(c[p], books[p][e]) for p, e in enumerate(at)) if c else None
        out.append((r[0], "".join(f"{e:02x}" for e in at) if c else None, min(error, (1 << 63) - 1) if c else None))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def coded(spark, rows, n=24):
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    df = spark.createDataFrame([(*r, "own", 5) for r in rows], "vec_id long, embedding array<double>, code string, entry int").repartition(4)
    got, books = codebooks.quantise(df)
    assert set(got.columns) == {"vec_id", "code", "error", "entry"}
    found = [(r.vec_id, r.code, r.error) for r in got.collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return found, codebooks.fingerprint(books)


def some_vectors(rng, n, length=16):
    centres = [[rng.uniform(-1, 1) for _ in range(length)] for _ in range(20)]
    return [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(n)]


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("partitions", [1, 24])
def test_codes_equal_plain_lloyd(spark, partitions):
    rng = random.Random(4)
    rows = some_vectors(rng, 300)
    rows += [(1000 + i, [0.5] * 16) for i in range(200)]                            # one group of copies
    rows += [(2000, None), (2001, [NAN] * 16), (2002, [INF] + [0.0] * 15), (2003, [None] + [0.0] * 15), (None, rows[3][1]), (5, rows[9][1])]
    want, books = plain_codes(rows)
    got, own = coded(spark, rows, partitions)
    assert sorted(got, key=key) == sorted(want, key=key) and own == books


def test_codes_of_odd_tables(spark):
    rng = random.Random(5)
    for rows in ([(3, [1.0] * 8), (1, [2.0] * 8)], [(i, [1.0, 2.0, 3.0]) for i in range(5)] + [(9, [1.0] * 8), (10, [])],
                 [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randint(0, 300) for _ in range(8)]) for i in range(40)]):
        want, books = plain_codes(rows)
        got, own = coded(spark, rows, 8)
        assert sorted(got, key=key) == sorted(want, key=key) and own == books
    assert coded(spark, [])[0] == [] and coded(spark, [(1, None)])[0] == []


def test_only_changed_parts_move(spark):
    rng = np.random.default_rng(3)
    members = rng.integers(-50, 50, (200, 2))
    books = [rng.integers(-50, 50, (4, 2))]
    own = codebooks.nearest(members, books[0])[0]
    state = [((0, e, 1), members[own == e]) for e in range(4)]
    assert list(codebooks._moving(books)(iter(state))) == []
    books = [books[0][::-1].copy()]
    stay = sum(len(m) for _, m in codebooks._staying(books)(iter(state)))
    moved = list(codebooks._moving(books)(iter(state)))
    assert stay + sum(len(m) for _, m in moved) == 200
    assert all((codebooks.nearest(m, books[0])[0] == k[1]).all() and k[2] == 1 for k, m in moved)
    owners = codebooks.Owners(24, 8, 16)
    places = Counter(owners((2, e, s)) for e in [7] for s in range(owners.salts))
    assert len(places) == owners.salts == 3            # a hot entry has all partitions of its position


def test_label_error_counts_nulls_together(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, None, 1), (4, None, 2)], "vec_id long, label string, error long")
    got = {r.vec_id: r.label_error for r in codebooks.with_group_error(df).collect()}
    assert got == {1: 12, 2: 12, 3: 3, 4: 3}


# --- importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain_features(t):
    words = WORD.findall(lower(t))
    return words, words + [a + " " + b for a, b in zip(words, words[1:])]


def plain_resample(docs, target):
    """[(doc_id, n_features, weight, score)] in the order of ``docs``, and how often each of those rows is drawn at each rank."""
    hashed = [(i, len(plain_features(t)[0]), [zlib.crc32(f.encode()) % 10000 for f in plain_features(t)[1]]) for i, t in docs]
    s = Counter(b for _, _, bs in hashed for b in bs)
    t = Counter(zlib.crc32(f.encode()) % 10000 for x in target for f in plain_features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in range(10000)]
    out = []
    for i, words, bs in hashed:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = Counter((r[0], r[2], r[3], r[4], k + 1) for k, r in enumerate(able[:25 * len(able) // 100]))
    drawn = Counter(r[:4] for r in ranks.elements())
    rest = Counter((r[0], *r[2:]) for r in out) - drawn
    return ranks + Counter((*r, None) for r in rest.elements())


def test_resample_equals_plain_version(spark, doc_rows):
    rng = random.Random(2)
    docs = [(r[0], r[1]) for r in doc_rows] + [(300 + i, "A" * rng.randint(40, 60) + " Über 3x " * i) for i in range(15)]
    docs += [(500, docs[0][1] * 3)] * 7 + [(None, docs[1][1])] * 4                  # repeated rows, null ids
    target = [docs[4][1][:200], None, "", "river stone market " * 10]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, score int, _row string, rank int").repartition(5)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    found = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect())
    assert found == plain_resample(docs, target)
    empty = importance.resample(df.limit(0), df.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns


def test_features_of_long_words_and_joins():
    import pyarrow as pa

    from emberline.llm.common import utf8
    texts = ["a" * 47 + " " + "b" * 48 + " c " + "d" * 500 + " e", None, "", "ÄÖ ß-x,y", " lead", "trail "]
    bucket, owner, words = importance.features(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        w, f = plain_features(t)
        assert words[i] == len(w)
        assert Counter(bucket[owner == i].tolist()) == Counter(zlib.crc32(x.encode()) % 10000 for x in f)


@pytest.mark.parametrize("values,wanted", [([5, 1, 1, 9, -3], 3), ([7] * 6, 4), ([-2 ** 63, 2 ** 63 - 1, 0], 2), (list(range(1000)), 777)])
def test_threshold_bisection(spark, values, wanted):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    at = sorted(values)[wanted - 1]
    assert importance.smallest_reaching(df, F.col("v"), wanted) == (at, sum(v < at for v in values))


def test_ties_are_drawn_by_id_then_row(spark):
    rows = [(10, None, 1), (10, 4, 2), (10, 4, 3), (10, 2, 4), (11, 9, 5), (10, None, 6), (9, 1, 7)]
    df = spark.createDataFrame(rows, "score long, doc_id long, _row long")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for n in range(8):
        assert {r._row for r in df.filter(importance.drawn(df, n)).collect()} == {r[2] for r in order[:n]}
    assert [r._row for r in importance.ranked(df).orderBy("rank").collect()] == [r[2] for r in order]


# --- lattice scores

@pytest.fixture(scope="module")
def vocabulary():
    return lattice.Vocabulary(public_tokenizers.path(lattice.VOCABULARY))


def every_path(word, weights):
    """Summed probability of all segmentations, by listing the cuts."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        p, start = 1.0, 0
        for e in ends:
            p *= weights.get(word[start:e], 0.0)
            start = e
        total += p
    return total


def test_forward_recursion_sums_all_segmentations(vocabulary):
    logs = np.log(vocabulary.zipf())
    weights = {p: math.exp(x) for p, x in zip(vocabulary.pieces, logs)}
    words = [b"the", b"tionhe", b"er", "éauxé".encode(), b"x", b"", "▁a".encode(), b"zzzz"]
    raw, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    found = lattice.marginals(vocabulary, logs, raw, at)
    assert np.allclose(np.exp(found), [every_path(b"\xff" + w, weights) for w in words], rtol=1e-9)
    # Expected counts: the derivative of the log marginal by a piece's log weight.
    counts = lattice.expected(vocabulary, logs, raw, at)
    for piece in (b"he", b"\xffthe", b"t", b"ion"):
        i, moved = vocabulary.pieces.index(piece), logs.copy()
        moved[i] += 1e-6
        assert counts[i] == pytest.approx((lattice.marginals(vocabulary, moved, raw, at).sum() - found.sum()) / 1e-6, abs=1e-4)
    # A very long word underflows no float.
    long = np.frombuffer(b"abc" * 4000, np.uint8)
    assert -200_000 < lattice.marginals(vocabulary, logs, long, np.array([0, len(long)]))[0] < -5000


def plain_scores(rows, vocabulary, logs, classes):
    """(n_tokens, n_known, N, base, score) of each row of (id, text, held_out, class), from dictionaries of counts."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])) for r in rows]
    learned = [not r[2] for r in rows]

    def sums(chosen):
        c = Counter(w for ws, y in zip(words, chosen) if y for w in ws)
        return c, sum(chosen), sum(c.values()) + sum(chosen)
    per = [sums(learned), *[sums([y and r[3] == k for y, r in zip(learned, rows)]) for k in classes]]
    c, ends, n = per[0]
    once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = once / (once + 2 * twice) if once else 0.5
    kinds = len(c) + (ends > 0)

    def own(w, k=0):
        below = math.exp(lattice.marginals(vocabulary, logs, np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0]) if k == 0 else own(w)
        return (max(per[k][0][w] - d, 0) + (d * len(per[k][0]) + 0.5) * below) / (per[k][2] + 1)
    out = []
    for ws in words:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in ws) + math.log10((ends + 0.1) / (n + 0.1 * (kinds + 1)))
        each = []
        for k, (_, texts, tokens) in enumerate(per):
            share = (ends - sum(p[1] for p in per[1:]) + 1 if k == 0 else texts) / (ends + 1)
            each.append(math.log10(share) + math.log10((texts + 0.5) / (tokens + 1)) + sum(math.log10(own(w, k)) for w in ws))
        top = max(each)
        out.append((len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, base, top + math.log10(sum(10 ** (x - top) for x in each))))
    return out


@pytest.mark.parametrize("hot_share", [3, 250_000])
def test_scores_equal_plain_version(spark, vocabulary, doc_rows, hot_share):
    rows = [(i, r[1], r[0] is not None and r[0] % 4 == 0, r[2]) for i, r in enumerate(doc_rows) if len(r[1] or "") < 2500]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, held_out boolean, lang string, p0 int, words string").repartition(3)
    counts = lattice.count_words(df.select("text", F.when(F.col("held_out"), -1).otherwise(0).alias("part"))).cache()
    logs = lattice.learn(counts, vocabulary, 1)
    got = {r.doc_id: r for r in lattice.score_texts(df, class_col="lang", rounds=1, hot_share=hot_share, most_classes=2).collect()}
    langs = Counter(r[3] for r in rows if not r[2] and r[3])
    classes = sorted(langs, key=lambda k: (-langs[k], k))[:2]
    want = plain_scores(rows, vocabulary, logs, classes)
    assert len(got) == len(rows)
    for r, w in zip(rows, want):
        g = got[r[0]]
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert g.base_score == pytest.approx(w[3], rel=1e-9) and g.score == pytest.approx(w[4], rel=1e-6)


def test_word_weights_are_a_distribution(vocabulary):
    """Counted words, the discounts' share and the end sum to one."""
    counts = {"the": 5, "of": 2, "river": 1, "stone": 1}
    model = lattice.Mixture([3], [sum(counts.values()) + 3], [len(counts)], 2, 1)
    known = np.exp(model.of(0, np.array(list(counts.values())), np.full(4, -np.inf))).sum()
    new = np.exp(model.of(0, np.zeros(1), np.zeros(1)))[0]                          # the paths through pieces sum to one
    assert known + new + 10 ** model.ends[0] == pytest.approx(1)


def test_scores_of_odd_tables(spark, vocabulary):
    kind = "doc_id long, text string, held_out boolean"
    assert lattice.score_texts(spark.createDataFrame([], kind)).count() == 0
    only = lattice.score_texts(spark.createDataFrame([(1, "a b", True), (2, None, True), (None, "x" * 5000, True)], kind)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in only} == {(1, 3, 0, 0), (2, 1, 0, 0), (None, 2, 0, 0)}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in only)
    empty = lattice.score_texts(spark.createDataFrame([(1, "", False), (2, None, False), (2, None, False)], kind)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in empty] == [(1, 1, 3)] * 3
