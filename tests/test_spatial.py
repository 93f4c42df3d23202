"""Joins against brute force, also across the antimeridian, at the poles and in dense places."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions.geo import haversine
from emberline.operators import clusters, enrichment, neighbours, ordered, polygons, proximity, split, timeline

R = 6_371_008.8
T0 = datetime(2026, 1, 1)


def dist(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def globe(n, seed):
    rnd = random.Random(seed)
    spots = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(n)]
    return spots + [(0.0, 179.9999), (0.0, -179.9999), (89.9999, 10.0), (89.9999, -170.0), (-90.0, 0.0), (51.0, -180.0), (51.0, 180.0)]


def events_df(spark, spots, times=None):
    rows = [(i, float(a), float(b), times[i] if times else T0) for i, (a, b) in enumerate(spots)]
    return spark.createDataFrame(rows, "event_id long, latitude double, longitude double, ts timestamp")


def fac_df(spark, spots, types=("refinery", "steel")):
    return spark.createDataFrame([(i, f"F{i}", f"n{i}", types[i % len(types)], float(a), float(b)) for i, (a, b) in enumerate(spots)],
                                 "ord long, facility_id string, name string, facility_type string, lat double, lon double")


def test_nearest_equals_brute_force_on_the_globe(spark):
    ev, fc = globe(150, 1), globe(60, 2)
    got = {r["event_id"]: r for r in proximity.nearest(events_df(spark, ev), fac_df(spark, fc)).collect()}
    assert len(got) == len(ev)
    for i, (a, b) in enumerate(ev):
        want = min((dist(a, b, c, d), j) for j, (c, d) in enumerate(fc))
        assert got[i]["distance_to_facility_m"] == pytest.approx(want[0], abs=1e-3)


def test_nearest_tie_goes_to_first_and_null_without_facilities(spark):
    ev = events_df(spark, [(10.0, 70.0)])
    out = proximity.nearest(ev, fac_df(spark, [(10.0, 70.1), (10.0, 69.9), (10.0, 70.1)])).first()
    assert out["nearest_facility_id"] in ("F0", "F1")
    twins = proximity.nearest(ev, fac_df(spark, [(11.0, 70.0), (10.0, 70.1), (10.0, 70.1)])).first()
    assert twins["nearest_facility_id"] == "F1"
    none = proximity.nearest(ev, fac_df(spark, [(0.0, 0.0)]).limit(0)).first()
    assert none["nearest_facility_id"] is None and none["distance_to_facility_m"] is None


@pytest.mark.parametrize("radius", [500.0, 5000.0])
def test_radius_counts_and_rows_kept(spark, radius):
    rnd = random.Random(3)
    ev, fc = [], []
    for lat, lon in ((12.0, 75.0), (60.0, 179.999), (-75.0, -179.999), (89.995, 0.0), (0.0, 0.0)):
        for _ in range(30):
            ev.append((min(90, lat + rnd.uniform(-.03, .03)), (lon + rnd.uniform(-.2, .2) + 180) % 360 - 180))
            fc.append((min(90, lat + rnd.uniform(-.03, .03)), (lon + rnd.uniform(-.2, .2) + 180) % 360 - 180))
    df = events_df(spark, ev).unionByName(spark.createDataFrame([(999, None, None, T0)], "event_id long, latitude double, longitude double, ts timestamp"))
    out = {r["event_id"]: r["n"] for r in proximity.radius_counts(df, fac_df(spark, fc), [("n", radius, None)]).collect()}
    assert out.pop(999) == 0 and len(out) == len(ev)
    for i, (a, b) in enumerate(ev):
        assert out[i] == sum(dist(a, b, c, d) <= radius for c, d in fc)


def brute_counts(spots, times, radius, days):
    out = []
    for i, (a, b) in enumerate(spots):
        out.append(sum(1 for j, (c, d) in enumerate(spots) if times[j] < times[i] and (days is None or times[i] - times[j] <= timedelta(days=days))
                       and dist(a, b, c, d) <= radius))
    return out


@pytest.mark.parametrize("dense_pairs", [10 ** 9, 50, 0])
def test_near_counts_ordinary_and_dense_agree_with_brute_force(spark, dense_pairs):
    rnd = random.Random(5)
    spots = [(10 + rnd.gauss(0, .004), 70 + rnd.gauss(0, .004)) for _ in range(120)] + [(10.001, 70.001)] * 30
    spots += [(0.001 * rnd.random(), (179.999 + 0.004 * rnd.random() + 180) % 360 - 180) for _ in range(40)]
    times = [T0 + timedelta(hours=rnd.randrange(0, 900)) for _ in spots]
    counts = [neighbours.NearCount("a", 500.0, 1), neighbours.NearCount("b", 500.0, 7), neighbours.NearCount("c", 1000.0)]
    df = events_df(spark, spots, times)
    got = {r["event_id"]: (r["a"], r["b"], r["c"]) for r in neighbours.near_counts(df, df, counts, dense_pairs=dense_pairs).collect()}
    want = list(zip(brute_counts(spots, times, 500, 1), brute_counts(spots, times, 500, 7), brute_counts(spots, times, 1000, None)))
    assert [got[i] for i in range(len(spots))] == want


def test_strictly_earlier_only_and_window_edge(spark):
    spots = [(10.0, 70.0)] * 4
    times = [T0, T0, T0 + timedelta(days=1), T0 + timedelta(days=1, microseconds=1)]
    df = events_df(spark, spots, times)
    got = {r["event_id"]: r["detections_24h"] for r in enrichment.persistence(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 1}
    future = events_df(spark, [(10.0, 70.0)], [T0 + timedelta(days=9)])
    assert enrichment.persistence(events_df(spark, spots[:1], times[:1]), future).first()["detections_30d"] == 0


def test_trailing_counts_on_a_hot_key(spark):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit(1).alias("site"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    out = enrichment.trailing_counts(df, "site").filter("event_id = 2999").first()
    assert (out["trailing_24h"], out["trailing_7d"]) == (1440, 2999)


def test_clusters_equal_union_find(spark):
    rnd = random.Random(7)
    spots = [(20 + rnd.gauss(0, .02), 80 + rnd.gauss(0, .02)) for _ in range(250)] + [(20.0, 80.0)] * 20
    spots += [(0.0, 179.999), (0.0, -179.999), (89.9995, 0.0), (89.9995, 180.0)]
    parent = list(range(len(spots)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(spots)):
        for j in range(i):
            if dist(*spots[i], *spots[j]) <= 500:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["event_id"]: r["cluster_id"] for r in clusters.assign_clusters(events_df(spark, spots), 500.0).collect()}
    assert got == {i: find(i) for i in range(len(spots))}


def test_cluster_chain_is_followed_to_its_end(spark):
    step = 450 / 111_195
    spots = [(5 + i * step, 75.0) for i in range(64)]
    out = clusters.assign_clusters(events_df(spark, spots), 500.0)
    assert out.select("cluster_id").distinct().count() == 1


SQUARE = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0)]
HOLE = [(4, 4, 6, 4), (6, 4, 6, 6), (6, 6, 4, 6), (4, 6, 4, 4)]


def edge_df(spark, parts):
    return spark.createDataFrame([(g, o, p, r, *map(float, e)) for g, o, p, r, es in parts for e in es],
                                 "geom_id string, ord long, poly int, ring int, x1 double, y1 double, x2 double, y2 double")


def test_polygon_with_hole_multipolygon_and_bad_points(spark):
    far = [(x1 + 20, y1, x2 + 20, y2) for x1, y1, x2, y2 in SQUARE]
    edges = edge_df(spark, [("b", 0, 0, 0, SQUARE), ("b", 0, 0, 1, HOLE), ("b", 0, 1, 0, far)])
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 5.0, 25.0), (4, 50.0, 5.0), (5, None, 3.0), (6, 95.0, 3.0)],
                               "event_id long, latitude double, longitude double")
    inside, outside = polygons.clip(df, edges)
    assert sorted(r["event_id"] for r in inside.collect()) == [1, 3]
    assert sorted(r["event_id"] for r in outside.collect()) == [2, 4, 5, 6]


def test_landcover_first_polygon_wins_and_distances(spark):
    edges = edge_df(spark, [("w", 1, 0, 0, SQUARE), ("f", 2, 0, 0, SQUARE), ("f", 2, 0, 1, HOLE)])
    cover = spark.createDataFrame([(1, "w", "water"), (2, "f", "forest")], "ord long, geom_id string, class string")
    df = events_df(spark, [(1.0, 1.0), (5.0, 12.0), (5.0, 5.0)])
    got = {r["event_id"]: r["landcover_class"] for r in polygons.landcover_of(df, cover, edges).collect()}
    assert got == {0: "water", 1: "unknown", 2: "water"}
    d = {r["event_id"]: (r["d"], r["x"]) for r in polygons.distance_to_classes(df, cover, edges, {"d": "forest", "x": "agriculture"}).collect()}
    assert d[0] == (0.0, None)
    assert d[1][0] == pytest.approx(dist(5, 12, 5, 10), rel=1e-6)
    # In the hole: outside, measured to the exterior ring.
    assert d[2][0] == pytest.approx(min(dist(5, 5, 0, 5), dist(5, 5, 5, 0)), rel=1e-3)


def test_nearest_geometry_inside_flag(spark):
    fac = spark.createDataFrame([(1, "P", "p", "steel", "Point", 1.0, 1.0), (2, "A", "a", "industrial_area", "Polygon", None, None)],
                                "ord long, facility_id string, name string, facility_type string, geom_type string, lat double, lon double")
    edges = edge_df(spark, [("A", 2, 0, 0, [(x1 + 20, y1, x2 + 20, y2) for x1, y1, x2, y2 in SQUARE])])
    got = {r["event_id"]: (r["nearest_facility_id"], r["inside_industrial_area"]) for r in
           polygons.nearest_geometry(events_df(spark, [(1.0, 1.0), (5.0, 25.0), (5.0, 19.9)]), fac, edges).collect()}
    assert got == {0: ("P", False), 1: ("A", True), 2: ("A", False)}


def test_quantiles_and_running_total(spark):
    rnd = np.random.default_rng(1)
    values = np.concatenate([rnd.lognormal(1, 2, 400).round(2), [-5.0, 0.0, 0.0, 1e6], np.full(300, 3.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["prob"]: r["value"] for r in ordered.exact_quantiles(df, ["v"], [0, 0.05, 0.5, 0.99, 1]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(float(np.quantile(values, p)), rel=1e-12)
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("k"), F.lit(2).cast("long").alias("w"))
    out = ordered.running_total(rows, ["k", "id"], "w", "t").orderBy("k", "id").collect()
    assert [r["t"] for r in out] == [2 * (i + 1) for i in range(500)]


def greedy(groups, total):
    n = int(total * 0.15)
    parts, used = {}, {"train": 0, "val": 0}
    room = {"train": total - 2 * n, "val": n}
    for part in ("train", "val"):
        count = 0
        for cid, size in groups:
            if cid in parts:
                continue
            if used[part] + size <= room[part] or count == 0:
                parts[cid], count = part, count + 1
                used[part] += size
                if used[part] >= room[part]:
                    break
    return {cid: parts.get(cid, "test") for cid, _ in groups}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_is_first_fit_in_time_order(spark, seed):
    rnd = random.Random(seed)
    sizes = [(i, rnd.choice([1, 1, 2, 3, 8, 20])) for i in range(40)]
    rows = [(cid, T0 + timedelta(hours=cid, minutes=k), cid * 100 + k) for cid, n in sizes for k in range(n)]
    df = spark.createDataFrame(rows, "cluster_id long, ts timestamp, id long")
    out = split.spatial_temporal_split(df)
    got = {r["cluster_id"]: r["split"] for r in out.select("cluster_id", "split").distinct().collect()}
    assert got == greedy(sizes, len(rows)) and out.count() == len(rows)
    assert split.split_overlap(out).isEmpty()


def test_span_counts_without_series_rows(spark):
    probes = spark.createDataFrame([(1, 0), (2, 5)], "k long, at long")
    series = spark.createDataFrame([(2, 4, 3), (2, 5, 9)], "k long, at long, n long")
    out = {r["k"]: (r["p"], r["s"]) for r in timeline.span_counts(series, probes, ["k"], [timeline.past("p", None), timeline.around("s", 1)]).collect()}
    assert out == {1: (0, 0), 2: (3, 12)}


def test_haversine_known_distance(spark):
    d = spark.range(1).select(haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first()["d"]
    assert d == pytest.approx(111_195.08, abs=0.1)
