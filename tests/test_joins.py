"""Joins whose copied side is far larger than its files suggest are never broadcast."""

from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from emberline.operators import neighbours, proximity
from tests.check_queries import compare

T0 = datetime(2026, 1, 1)
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, site long, latitude double, longitude double, ts timestamp")


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("counts", [[neighbours.NearCount("a", 500.0, 7)], [neighbours.NearCount("a", 1000.0)]])
@pytest.mark.parametrize("symmetric", [False, True])
def test_copied_history_is_not_broadcast(spark, tmp_path, counts, symmetric):
    _events(spark, [(i, i, 10.0 + i / 1000, 70.0, T0) for i in range(50)]).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    plan = _plan(neighbours.near_counts(events, events, counts, symmetric))
    pairs = [line for line in plan.splitlines() if "Join" in line and "cy#" in line and "cx#" in line]
    assert pairs and not any("BroadcastHashJoin" in line for line in pairs)


def test_copied_targets_are_not_broadcast(spark, tmp_path):
    _events(spark, [(i, i, 10.0 + i / 1000, 70.0, T0) for i in range(50)]).write.parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    targets = events.selectExpr("latitude as lat", "longitude as lon", "'steel' as facility_type")
    plan = _plan(proximity.radius_counts(events, targets, proximity.FACILITY_COUNTS))
    pairs = [line for line in plan.splitlines() if "Join" in line and "cy#" in line and "cx#" in line]
    assert pairs and not any("BroadcastHashJoin" in line for line in pairs)


def _tables(con, folder, events, customers):
    """Events (event_id, user_id, hour) and customers by key, as the tables have them."""
    rows = ", ".join(f"({e}, {u}, {h})" for e, u, h in events)
    con.execute(f"""copy (select t.e::bigint as event_id, timestamp '2024-01-01' + to_hours(t.h::int) as ts, t.u::bigint as user_id,
        'view' as event_type, 1e0 as value, '' as props from (values {rows}) t(e, u, h)) to '{folder}/events.parquet' (format parquet)""")
    keys = ", ".join(f"({k})" for k in customers)
    con.execute(f"""copy (select t.k::bigint as c_custkey, 'c' as c_name, 1::int as c_nationkey, 0e0 as c_acctbal, 'x' as c_mktsegment
        from (values {keys}) t(k)) to '{folder}/customer.parquet' (format parquet)""")
    con.execute("set timezone='UTC'")
    for t in ("events", "customer"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")


@pytest.mark.parametrize("key", ["boundary_clip", "clip_report"])
def test_points_on_the_boundary_equal_their_sql(spark, tmp_path, key):
    # The vertex (9, 72), and (9.001, 71.9996) on the edge that ends there.
    users = next(u for u in range(70_000) if u * 37 % 251 == 10 and u * 53 % 257 == 30)
    ids = [next(e for e in range(20_000) if e * 17 % 101 == 50 + i and e * 29 % 103 == 51 + j) for i, j in ((0, 0), (10, -4), (20, -8))]
    con = duckdb.connect()
    _tables(con, tmp_path, [(e, users, 0) for e in ids], [10])
    verdict = compare(QUERIES[key](spark, str(tmp_path)), con, CHECKS[key])
    assert verdict.startswith("ok"), verdict


def test_facility_baseline_keeps_sites_apart_that_share_a_position(spark, tmp_path):
    def close(site):     # its facility lies within some 300 m
        return abs(70 * site % 41 - 20) <= 2 and abs(110 * site % 43 - 21) <= 2

    con, apart = duckdb.connect(), 251 * 257
    one, other = next((s, s + apart * k) for s in range(1, 9000) for k in range(1, 9) if close(s) and close(s + apart * k))
    _tables(con, tmp_path, [(i, (one, other)[i % 2], 5 * i) for i in range(40)], [10 * one, 10 * other])
    key = "facility_point_baseline"
    verdict = compare(QUERIES[key](spark, str(tmp_path)), con, CHECKS[key])
    assert verdict.startswith("ok"), verdict


def test_nearest_of_all_groups_is_gathered_without_another_shuffle(spark):
    """Merged by cell, the nearest of a point's groups lie in one partition: one shuffle of positions, one of the result, one of the events."""
    events = spark.range(50).selectExpr("id as event_id", "10 + id / 1000D as latitude", "70D as longitude")
    items = spark.range(60).selectExpr("id as ord", "10 + id / 900D as lat", "70.01D as lon", "case id % 3 when 0 then 'steel' when 1 then 'cement' else 'refinery' end as facility_type")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = proximity.nearest_by_category(events, items, proximity.CATEGORIES)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("Exchange hashpartitioning(latitude" in line or "Exchange hashpartitioning(knownfloatingpointnormalized" in line for line in plan.splitlines()) <= 3


def test_row_multiplicity_enriches_once(spark):
    from emberline.operators.analytics import multiplicity_by
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, None)]
    before, after = (spark.createDataFrame(r, "id int, satellite string") for r in (rows, [*rows[1:], (2, "b"), (4, "c")]))
    got = sorted((r.satellite or "", r.rows_in, r.rows_out, r.differing) for r in multiplicity_by(before, after, before.columns, "satellite").collect())
    assert got == [("", 1, 1, 0), ("a", 2, 1, 1), ("b", 1, 2, 1), ("c", 0, 1, 1)]
    plan = QUERIES["row_multiplicity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # The temporal counts, the nearest facility, the facility counts and the nearest of each category are joined once each.
    assert sum("Join LeftOuter" in line for line in plan.splitlines()) == 4
