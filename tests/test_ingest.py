"""The streaming ingest keeps what it rejects."""

from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from emberline.operators.clean import clean_events
from emberline.plans.queries_clean import raw_feed
from emberline.streaming import ingest

SF = "/root/testdata/sf0.001"
GOOD = "10.5,20.25,330.0,290.0,0.4,0.4,2026-01-02,0130,N,VIIRS,n,2.0,,5.0,D"


def test_ingest_keeps_rejects(spark, tmp_path):
    """Malformed rows of every landed file can be found again; a second run adds nothing."""
    header = ",".join(ingest.RAW_COLUMNS)
    landing, out, bad = tmp_path / "in", tmp_path / "out", tmp_path / "bad"
    landing.mkdir()

    def run():
        ingest.ingest(spark, str(landing), str(out), str(tmp_path / "state"), rejects=str(bad)).awaitTermination()
        return (spark.read.parquet(str(out)).count(),
                sorted((r.reason, r["raw"]["latitude"], r["_file"][-5:]) for r in spark.read.parquet(str(bad)).collect()))

    (landing / "a.csv").write_text("\n".join([header, GOOD, GOOD.replace("10.5", "95.0"), GOOD.replace("10.5", "north")]) + "\n")
    first = run()
    assert first[0] == 1 and [(x[1], x[2]) for x in first[1]] == [("95.0", "a.csv"), ("north", "a.csv")]
    assert run() == first
    (landing / "b.csv").write_text("\n".join([header, GOOD.replace("10.5", "11.5"), GOOD.replace("20.25", "999")]) + "\n")
    n, rejects = run()
    assert n == 2 and len(rejects) == 3 and sum(x[2] == "b.csv" for x in rejects) == 1


def test_stream_ingest_counts_both(spark):
    valid, rejects = clean_events(raw_feed(spark, SF))
    want = Counter({"valid": valid.count(), "reject": rejects.count()})
    got = Counter()
    for r in entry.queries()["stream_ingest"](spark, SF).groupBy("outcome").agg(F.sum("rows").alias("n")).collect():
        got[r.outcome] = r.n
    assert got == want and got["reject"] > 0
    print(dict(got))
