"""Row numbers and what is matched by them hold when a later job splits the files differently."""

from contextlib import contextmanager

from emberline.llm import paragraphs, toxicity, windows


@contextmanager
def one_split(spark):
    """All files in one scan task, as with fewer executors."""
    conf = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in conf:
            spark.conf.unset(k)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_row_numbers_hold(spark, doc_dir):
    def docs():
        return spark.read.parquet(f"{doc_dir}/documents.parquet").select("doc_id", "text")

    want = sorted_rows(paragraphs.with_rows(docs(), True))
    assert len({r[-1] for r in want}) == len(want) == docs().count() and docs().rdd.getNumPartitions() > 1
    with one_split(spark):
        assert docs().rdd.getNumPartitions() == 1
        assert sorted_rows(paragraphs.with_rows(docs(), True)) == want


def test_windows_hold(spark, doc_dir):
    want = sorted_rows(windows.op5_windows(spark, doc_dir))
    again = windows.op5_windows(spark, doc_dir)             # its side tables are written; the last scan is still to come
    with one_split(spark):
        assert sorted_rows(again) == want


def test_labels_hold(spark, doc_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{doc_dir}/documents.parquet").select("doc_id", "text").dropna()
    spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def learn(rows):
        return seen.append(sorted_rows(rows.select("doc_id", "text", "label"))) or (toxicity.np.zeros(toxicity.BUCKETS), 0.0)

    def land(rows, name):
        with one_split(spark):
            return real(rows, name)

    real = toxicity.land
    monkeypatch.setattr(toxicity, "learn", learn)
    monkeypatch.setattr(toxicity, "land", land)
    toxicity.op9_toxicity(spark, str(tmp_path))
    want = [(r.doc_id, r.text, r.doc_id % 2) for r in docs.filter(~toxicity.held_out()).filter("doc_id < 90").collect()]
    assert seen == [sorted(want, key=str)] and len(want) > 30
