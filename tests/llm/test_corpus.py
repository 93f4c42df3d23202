"""Corpus operators against plain-Python versions on a small table with odd rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from emberline.llm import binary_ids, mixture, neardup, packing, paragraphs, quality
from emberline.llm.common import link_groups

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *cols):
    return sorted(([r[c] for c in ("doc_id", *cols)] for r in df.collect()), key=str)


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_quality_counts(spark, doc_dir, doc_rows):
    want = []
    for i, t, *_ in doc_rows:
        words = TOKEN.findall(t or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {k for j in range(len(words) - 2) if grams[tuple(words[j:j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if TOKEN.search(x)]
        n, rep = len(words), len(hit)
        want.append([i, n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep,
                     n < 50 or 100 * rep > 50 * n])
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality.op1_divergence(spark, doc_dir)
    assert by_id(got, *cols) == sorted(want, key=str)
    assert got.filter("kept and base_failed").count() == 0
    assert got.filter("not base_failed and not kept").count() <= 3


def test_clean_texts_of_any_language_stay(spark, doc_rows):
    """A language that no fixed list knows, at any length, with or without enough text for a reference; junk in ordinary letters goes."""
    rng = random.Random(9)
    names = ["".join(rng.choice("klmnoprstuvaei") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def prose_of(n):
        return " ".join(rng.choice(["qo", "ti", "sam", "vul", "ne"]) if rng.random() < 0.35 else rng.choice(names) for _ in range(n))
    rows = [(i, prose_of(n), "xx", n) for i, n in enumerate(rng.choice([60, 100, 319, 320, 800]) for _ in range(80))]
    rows += [(1000 + i, prose_of(n), "yy", n) for i, n in enumerate([100, 320])]          # too little text for a reference
    junk = [(2000 + i, " ".join("".join(rng.choice("aeionrtls") for _ in range(7)) for _ in range(n)), "xx", n) for i, n in enumerate([150, 400, 900])]
    df = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, n int").repartition(3)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert all(got[r[0]].kept for r in rows), [(r[2:], got[r[0]].word_distance) for r in rows if not got[r[0]].kept]
    assert not any(got[r[0]].kept for r in junk)
    assert set(quality.learn_words(df)) >= {"qo", "ti", "sam", "vul", "ne"}


def test_verdict_equals_plain_version(spark, doc_rows):
    """The distances and the verdict from dictionaries of counts."""
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in doc_rows], "doc_id long, text string, lang string").repartition(4)
    common = quality.learn_words(df)
    got = quality.judge(df).collect()
    def chars(t):
        h = np.zeros(quality.CLASSES)
        for b in (t or "").encode():
            k = quality._CLASS[b]
            if k < quality.CLASSES:
                h[k] += 1
        return h
    def words(t):
        c = Counter((t or "").encode().split())
        h = [c.pop(w.encode(), 0) for w in common]
        return np.array([*h, sum(c.values())], float)
    def distance(h, r):
        p, q = h / h.sum(), r / r.sum()
        m = (p + q) / 2
        return np.sqrt(max(0, sum(x * np.log2(x / y) for x, y in zip(p, m) if x) + sum(x * np.log2(x / y) for x, y in zip(q, m) if x)) / 2)
    rows = [(r.text, r.lang, r.base_failed, r) for r in got]
    def refs(use):
        out = {}
        for lang in {r[1] for r in rows if r[1]}:
            own = [r for r in rows if r[1] == lang and not r[2] and use(r)]
            c, w = sum((chars(r[0]) for r in own), np.zeros(quality.CLASSES)), sum((words(r[0]) for r in own), np.zeros(len(common) + 1))
            if c.sum() >= quality.REFERENCE_CHARS:
                out[lang] = (c, w)
        return out
    def nearest(h, some, k):
        return min((distance(h, r[k]) for r in some.values()), default=None) if h.sum() else None
    first = refs(lambda r: True)
    second = refs(lambda r: (d := nearest(chars(r[0]), first, 0)) is not None and d <= quality.TRIM)
    for t, lang, failed, r in rows:
        bad = False
        for h, k, n, bins, (least, limit, widen), seen in ((chars(t), 0, chars(t).sum(), quality.CLASSES, quality.CHAR_RULE, r.char_distance),
                                                           (words(t), 1, len((t or "").split()), len(common) + 1, quality.WORD_RULE, r.word_distance)):
            d = nearest(h, second, k)
            assert (seen is None) == (d is None) and (d is None or abs(d - seen) < 1e-6)
            bad |= d is not None and n >= least and d > limit + widen * np.sqrt(bins / (n + 1)) / 2
        assert r.kept == (not failed and not (bad and (lang is None or lang in second)))


def test_js_distance():
    ref = np.array([2.0, 1.0, 1.0, 0.0])
    got = quality.js_distance(np.array([[4.0, 2, 2, 0], [0, 0, 0, 5], [0, 0, 0, 0]]), ref)
    assert got[0] == 0 and got[1] == 1 and np.isnan(got[2])


def simhash(t):
    words = [w.encode() for w in TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hs = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, doc_dir, doc_rows):
    fps = [simhash(r[1]) for r in doc_rows]
    n = len(fps)
    comp = roots(n, [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = [min((doc_rows[j][0] for j in range(n) if comp[j] == c and doc_rows[j][0] is not None), default=None) for c in comp]
    want = [[r[0], f"{f:016x}", c] for r, f, c in zip(doc_rows, fps, least)]
    assert by_id(neardup.op2_simhash(spark, doc_dir), "fingerprint", "component_id") == sorted(want, key=str)


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, np.int64)
    fps = {0, -1}
    for b in base.tolist():
        fps.add(b)
        for _ in range(12):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(bit)
            fps.add(x if x < 2**63 else x - 2**64)
    fps = sorted(fps)
    u = [f % 2**64 for f in fps]
    want = sorted((fps[i], fps[j]) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (u[i] ^ u[j]).bit_count() <= 2)
    got = sorted((r.a, r.b) for r in neardup.links(spark.createDataFrame([(f,) for f in fps], "_fp long")).collect())
    assert got == want and len(want) > 300


def lines_of(t):
    return [(i, TOKEN.findall(x.lower())) for i, x in enumerate((t or "").split("\n"))
            if len(TOKEN.findall(x)) >= paragraphs.LEAST_WORDS]


def test_paragraphs(spark, doc_dir, doc_rows):
    docs = spark.read.parquet(f"{doc_dir}/documents.parquet").select("doc_id", "text")
    order = [(r.doc_id, r.text) for r in paragraphs.with_rows(docs, True).orderBy("_row").collect()]
    items = [(d, i, frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))) for d, (_, t) in enumerate(order) for i, w in lines_of(t)]
    sim = [(a, b) for a in range(len(items)) for b in range(a) if items[a][2] and len(items[a][2] & items[b][2])
           / len(items[a][2] | items[b][2]) >= 0.8]
    comp = roots(len(items), sim)
    want = {d: [] for d in range(len(order))}
    for k, c in enumerate(comp):
        if c != k:
            want[items[k][0]].append(items[k][1])
    got = by_id(paragraphs.op4_paragraphs(spark, doc_dir), "removed_lines")
    assert got == sorted(([order[d][0], v] for d, v in want.items()), key=str)
    assert sum(map(len, want.values())) > 20
    kept = paragraphs.deduplicate(spark.read.parquet(f"{doc_dir}/documents.parquet"), stored=True)
    assert kept.columns == spark.read.parquet(f"{doc_dir}/documents.parquet").columns
    left = Counter(line for r in kept.collect() for line in set((r.text or "").split("\n")) if len(TOKEN.findall(line)) >= paragraphs.LEAST_WORDS)
    assert max(left.values()) == 1


def pieces_of(text):
    """Words and characters of each content-defined piece of one text, cut on its own."""
    import pyarrow as pa

    from emberline.llm.common import utf8
    found = paragraphs.Paragraphs(*utf8(pa.array([text], pa.string()))).pieces()
    out = []
    for n, a, b in zip(found["n_words"].tolist(), found["at"].tolist(), found["till"].tolist()):
        part = (text or "")[a:b]
        words = tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TOKEN.findall(part))
        assert len(words) == n
        out.append((words, a, b))
    assert sum((w for w, _, _ in out), ()) == tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TOKEN.findall(text or ""))
    return out


def test_passages_equal_plain_version(spark, doc_rows):
    order = [(i, r[1]) for i, r in enumerate(doc_rows)]
    seen, want = {}, []
    for row, text in order:
        cut = pieces_of(text)
        again = []
        for k, (words, a, b) in enumerate(cut):
            if len(words) < paragraphs.SHINGLE:
                continue
            if words in seen:
                again.append((k, a, b, seen[words], len(words)))
            else:
                seen[words] = row
        runs = []
        for x in again:
            if runs and runs[-1][-1][0] == x[0] - 1:
                runs[-1].append(x)
            else:
                runs.append([x])
        want += [(row, k, a, b, keep) for run in runs if sum(x[4] for x in run) >= paragraphs.LEAST_RUN for k, a, b, keep, _ in run]
    docs = spark.createDataFrame(order, "_row long, text string").repartition(5)
    got = paragraphs.repeated_passages(docs).collect()
    assert sorted((r._row, r.piece, r["at"], r.till, r.keep_row) for r in got) == sorted(want) and len(want) > 20


def test_passages_are_caught_however_they_are_wrapped(spark):
    rng = random.Random(12)

    def words(n):
        return ["".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    rows, planted, clean = [], {}, []
    common = " ".join(words(9))
    for k in range(40):
        passage = words(rng.randint(52, 75))
        forms = [" ".join(passage), "\n".join(" ".join(passage[i:i + 9]) for i in range(0, len(passage), 9)), "\n".join(passage)]
        for j in range(3):
            before, after = " ".join(words(rng.randint(5, 80))), " ".join(words(rng.randint(5, 80)))
            rows.append((len(rows), f"{before} {forms[j]} {after}"))
            planted[rows[-1][0]] = (j, passage, before, after)
        clean.append(len(rows))
        rows.append((len(rows), " ".join(words(rng.randint(60, 200))) + "\n" + common + "\n" + " ".join(words(30))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    left = {r.doc_id: r.text for r in paragraphs.deduplicate(docs).collect()}
    texts = dict(rows)
    later = [i for i, p in planted.items() if p[0] > 0]
    assert np.mean([left[i] != texts[i] for i in later]) >= 0.95
    for i in later:
        _, passage, before, after = planted[i]
        assert set(TOKEN.findall(before) + TOKEN.findall(after)) <= set(TOKEN.findall(left[i]))      # only the passage goes
    assert all(left[i] == texts[i] for i in [*clean, *[i for i, p in planted.items() if p[0] == 0]])


def test_paragraph_rest_path(spark):
    """Members of a bucket that miss the most frequent one still find each other."""
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words)] * 3
    for _ in range(25):
        w = list(words)
        for j in rng.integers(0, 60, 3):
            w[j] = f"z{rng.integers(4)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    sets = [{tuple(t.split()[k:k + 5]) for k in range(56)} for t in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    comp = roots(len(texts), near)
    got = {r._row for r in paragraphs.duplicate_lines(docs).collect()}
    assert got == {k for k, c in enumerate(comp) if c != k}


@pytest.mark.parametrize("seed", [1, 2])
def test_link_groups(spark, seed):
    """Chains, a star around a large id, a dense group, repeated and self links against union-find."""
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(40)] + [(999, 100 + i) for i in range(30)] + [(7, 7), (500, 500)]
    links += [(200 + i, 200 + j) for i in range(15) for j in range(15) if i != j]
    links += [(rng.randrange(300, 420), rng.randrange(300, 420)) for _ in range(70)]
    up = roots(1000, links)
    want = {n: up[n] for a, b in links if a != b for n in (a, b)}
    got = link_groups(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert link_groups(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_mixture(spark, doc_dir, doc_rows):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{doc_dir}/documents.parquet/*.parquet'")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted((list(r) for r in con.execute(f"select {', '.join(cols)} from ({mixture.SQL})").fetchall()), key=str)
    df = mixture.op8_mixture(spark, doc_dir)
    assert by_id(df, *cols[1:]) == want
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    whole, taken = sum(r[1] for r in want), sum(r[4] for r in want)
    assert abs(taken - 1.5 * whole) <= 6
    assert all(r[4] <= 2 * r[1] for r in want)


def test_mixture_clamps(spark):
    sizes = spark.createDataFrame([(".a", 10), (".b", 1000), (".c", 1000), ("/", 0)], "_s string, size long")
    got = {r._s: r.target for r in mixture.source_targets(sizes, (3, 1, 2), 1.0).collect()}
    assert got["/"] == 0 and got[".a"] == 20 and abs(got[".b"] - 1990 / 3) < 1e-9 and abs(got[".c"] - 3980 / 3) < 1e-9


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10**6), (3000, 2**40), (700, 50)):
        values = np.sort(rng.integers(0, top, n))
        coded, rest = binary_ids.EliasFano.from_bytes(memoryview(binary_ids.EliasFano.encode(values, top).to_bytes() + b"x"))
        assert bytes(rest) == b"x" and coded.values().tolist() == values.tolist()
        assert [coded.select(i) for i in range(n)] == values.tolist()
    doc_ids = [None, None, -2**63, -5, -5, 0, 7, 2**62]
    ends = np.arange(1, 9) * 3
    ids = np.arange(24, dtype="<u2")
    got, bounds, back = binary_ids.parse_file(binary_ids.file_bytes(ids.tobytes(), 2, ends, doc_ids))
    assert got == doc_ids and bounds.values().tolist() == ends.tolist() and back.tolist() == ids.tolist()


def test_id_files(spark, doc_dir, doc_rows):
    tok = Tokenizer.from_file(public_tokenizers.path(binary_ids.VOCABULARY))
    rows = sorted(doc_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append([r[0], start, len(ids), zlib.crc32(ids.tobytes())])
        start += len(ids)
    assert by_id(binary_ids.op6_elias_fano(spark, doc_dir), "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packing(spark, doc_dir, doc_rows):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for r in doc_rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want.append([r[0], k, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())])
    got = packing.op10_packing(spark, doc_dir)
    assert by_id(got, "piece", "start", "length", "ids_crc32") == sorted(want, key=str)
    assert checked(got.collect(), 2048) == best_fit_decreasing([w[3] for w in want], 2048)


def checked(rows, capacity):
    per = {}
    for r in rows:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(per)


@pytest.mark.parametrize("seed", range(6))
def test_supersteps_equal_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 400) if seed % 2 else np.minimum(100, rng.geometric(0.07, 700))
    counts = Counter(lengths.tolist())
    places = []
    for length, lo, hi, first, each, at in packing.supersteps(counts, 100):
        places += [(first + (r - lo) // each, at + (r - lo) % each * length, length) for r in range(lo, hi)]
    assert Counter(p[2] for p in places) == counts
    per = {}
    for s, at, n in places:
        per.setdefault(s, []).append((at, n))
    for own in per.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= 100
    assert len(per) == best_fit_decreasing(lengths.tolist(), 100)


def test_empty_table(spark, empty_dir):
    for op in (quality.op1_divergence, neardup.op2_simhash, paragraphs.op4_paragraphs, binary_ids.op6_elias_fano,
               mixture.op8_mixture, packing.op10_packing):
        assert op(spark, empty_dir).collect() == []


def test_pipeline(spark, doc_dir, doc_rows):
    docs = spark.read.parquet(f"{doc_dir}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.land(stage(spark, docs, doc_dir), "t")
        assert docs.columns == names, name
    want = corpus_pipeline.STAGES[-1][1](spark, docs, doc_dir)
    got = corpus_pipeline.run(spark, doc_dir)
    assert by_id(got, "piece", "ids_crc32") == by_id(want, "piece", "ids_crc32")
    assert checked(got.collect(), 2048) >= 1
