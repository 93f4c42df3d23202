"""The near-dedup stage of the pipeline against brute force: Jaccard of five-word shingles of at least 0.8."""

import random
import re
import time

import corpus_pipeline

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = TOKEN.findall((text or "").lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_edited_copies_go(spark):
    rng = random.Random(11)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(200)]
        rows.append([2 * len(rows) + 5, " ".join(words)])
        for edits in (1, 2, 3, 4, 7, 12):            # Jaccard from about 0.95 down to about 0.55
            copy = list(words)
            for place in rng.sample(range(200), edits):
                copy[place] = f"x{rng.randrange(4000)}"
            rows.append([2 * len(rows) + 5, "\n".join([" ".join(copy[:90]), " ".join(copy[90:])])])
    rows += [[1, "a b"], [2, "a B"], [3, "a b c"], [4, None], [6, " \n"], [None, rows[0][1]], [None, "no id " * 9], [None, "no id " * 9]]
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                up[find(a)] = find(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    want = sorted(min((d for d in g if d is not None), default=-1) for g in groups.values())
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").repartition(3)
    got = sorted(-1 if r.doc_id is None else r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    assert got == want and 20 < len(want) < len(rows) - 20


def test_linked_fingerprints_and_similar_texts_meet_in_one_group(spark, monkeypatch):
    """The stage goes by op2's fingerprints too: a text that only they link is dropped, also through a third text."""
    from emberline.llm import neardup
    texts = [" ".join(f"{k}{i}" for i in range(60)) for k in "abcd"]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate([*texts, texts[1] + " more"])], "doc_id long, text string")

    def prints(df, text="text", words=3, keep_text=True):           # a and b are two bits apart
        from pyspark.sql import functions as F
        fp = F.when(F.col(text).startswith("a"), 0).when(F.col(text) == texts[1], 3).otherwise(F.xxhash64(text))
        return df.withColumn("_fp", fp.cast("long")).select(*[c for c in df.columns if keep_text or c != text], "_fp")

    monkeypatch.setattr(neardup, "fingerprints", prints)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    assert got == [1, 3, 4]


def test_a_group_of_variants_is_not_paired_with_itself(spark, monkeypatch):
    """Variants of one, two and three edits: many pairs are similar, but once pivots have joined the group no more of them are tested."""
    from emberline.llm import neardup, paragraphs
    rng = random.Random(3)
    base, rows = [f"w{rng.randrange(4000)}" for _ in range(200)], []
    for i in range(120):
        copy = list(base)
        for place in rng.sample(range(200), 1 + i % 3):
            copy[place] = f"x{i} {rng.randrange(4000)}"
        rows.append((i, " ".join(copy)))
    tested, measure = [], paragraphs._measured

    def counted(pairs, sets):
        tested.append(pairs.count())
        return measure(pairs, sets)

    monkeypatch.setattr(paragraphs, "_measured", counted)
    docs = paragraphs.with_rows(spark.createDataFrame(rows, "doc_id long, text string"), False)
    groups = [r.group for r in neardup.similar_groups(docs.select("_row", "text")).collect()]
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(120) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 2000 and len(groups) == 120 and len(set(groups)) == 1
    assert tested[0] < 1200 and sum(tested[1:]) < 600


def test_shuffle_files_go_when_a_query_ends(spark):
    """Rounds of small shuffles don't pile up files beside a stage of the pipeline."""
    from emberline.llm.common import land, small_batches
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        held = disk.getAllFiles()
        return {name for name in (held.apply(i).getName() for i in range(held.size())) if name.startswith("shuffle_")}

    small_batches(spark)
    before = files()
    land(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "cleanup-test")
    for _ in range(20):                     # they are removed a moment later
        left = files() - before
        if not left:
            break
        time.sleep(0.5)
    assert not left


def _joins(df):
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]


def test_the_grid_of_fingerprints_is_not_broadcast(spark, tmp_path):
    """Catalyst sees the file of the fingerprints, not their up to 33 rows each: 805 MB were broadcast on 0.51 GB."""
    from emberline.llm import neardup
    spark.range(200).selectExpr("id * 3 as _fp").write.parquet(str(tmp_path / "prints"))
    found = neardup.links(spark.read.parquet(str(tmp_path / "prints")))
    joins = _joins(found)
    assert joins and not any("Broadcast" in line for line in joins)
    prints = [3 * i for i in range(200)]
    want = sorted((a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2)
    assert sorted(map(tuple, found.collect())) == want


def test_shingle_sets_are_not_broadcast(spark, tmp_path):
    """An array counts as one element in Catalyst's size of a file's columns: 71 MB were broadcast three times on 0.51 GB."""
    from emberline.llm import paragraphs
    spark.range(20).selectExpr("id as pid", "sequence(id, id + 9) as shingles").write.parquet(str(tmp_path / "sets"))
    spark.range(19).selectExpr("id as a", "id + 1 as b").write.parquet(str(tmp_path / "pairs"))
    found = paragraphs._measured(*[spark.read.parquet(str(tmp_path / t)) for t in ("pairs", "sets")])
    joins = _joins(found)
    assert len(joins) == 2 and not any("Broadcast" in line for line in joins)
    assert {(r.b - r.a, round(r.dist, 6)) for r in found.collect()} == {(1, round(1 - 9 / 11, 6))}
