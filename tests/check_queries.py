"""Run registered queries against their DuckDB checks: ``python tests/check_queries.py [sf_dir] [key ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from emberline.fixtures import TABLES
from emberline.session import build_session


def _plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


TIMES: list[tuple[float, float]] = []


def compare(spark_df, con, sql: str) -> str:
    got_cols = sorted(spark_df.columns)
    t0 = time.time()
    rows = spark_df.collect()
    t1 = time.time()
    res = con.execute(sql)
    want_cols = sorted(d[0] for d in res.description)
    order = [[d[0] for d in res.description].index(c) for c in want_cols]
    want = sorted(tuple(_plain(r[i]) for i in order) for r in res.fetchall())
    TIMES.append((t1 - t0, time.time() - t1))
    got = sorted(tuple(_plain(r[c]) for c in got_cols) for r in rows)
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    norm = [(tuple(x[:-2] if x.endswith(".0") else x for x in g), tuple(x[:-2] if x.endswith(".0") else x for x in w)) for g, w in bad]
    real = [(g, w) for g, w in norm if g != w]
    if real:
        return f"VALUES {len(real)}/{len(got)} differ, e.g. {real[0]}"
    return "ok" if not bad else f"ok (number types differ: {bad[0]})"


def main(argv: list[str]) -> int:
    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv if not a.startswith("/")]
    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                                  "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in keys or queries:
        t0 = time.time()
        try:
            df = queries[key](spark, sf)
            if key in checks:
                verdict = compare(df, con, checks[key])
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as e:  # report and go on
            verdict = "ERROR " + str(e)[:600].replace("\n", " ")
        bad += not (verdict.startswith("ok") or verdict.startswith("rows only"))
        took = f"{time.time() - t0:6.1f}s" + (f" (check {TIMES[-1][1]:.1f}s)" if TIMES else "")
        print(f"{key:28s} {took}  {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
