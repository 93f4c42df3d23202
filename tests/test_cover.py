"""Cell covers of polygons against the plain ray test over all edges."""

import math
import random

from pyspark.sql import functions as F

from emberline.operators import polygons
from emberline.operators.learn import ablate

EDGE = "geom_id string, ord long, poly int, ring int, x1 double, y1 double, x2 double, y2 double"


def sides(points):
    return list(zip(points, points[1:] + points[:1]))


def star(rng, x, y, size, n):
    angles = [2 * math.pi * i / n for i in range(n)]
    return [(x + size * rng.uniform(0.3, 1) * math.cos(a), y + size * rng.uniform(0.3, 1) * math.sin(a)) for a in angles]


def stairs(x, y, n, step):
    """A staircase: level and upright edges, vertices on grid lines, many ends at one height."""
    up = [p for i in range(n) for p in ((x + i * step, y + (i % 4) * step), (x + (i + 1) * step, y + (i % 4) * step))]
    return up + [(x + n * step, y + 8 * step), (x, y + 8 * step)]


def shapes(rng):
    out = []
    for g in range(12):
        x, y, size = rng.uniform(-170, 150), rng.uniform(-80, 70), 10.0 ** rng.uniform(-3, 1)
        out.append((f"s{g}", 0, 0, star(rng, x, y, size, rng.choice([3, 5, 40, 300]))))
        out.append((f"s{g}", 0, 1, [(x + size * dx, y + size * dy) for dx, dy in ((.05, 0), (0, .06), (-.05, 0), (0, -.05))]))
        out.append((f"s{g}", 1, 0, star(rng, x + 3 * size, y, size, 7)))
    out += [("t0", 0, 0, stairs(10.0, 5.0, 32, 0.125)), ("t1", 0, 0, stairs(-20.0, -4.0, 9, 1.0)),
            ("t2", 0, 0, [(0, 0), (4, 0), (4, 4), (0, 4)]), ("t3", 0, 0, [(1.3, 1.3)] * 3), ("t4", 0, 0, [(0, 9), (3, 9 + 1e-12), (3, 10), (0, 10)])]
    return [(g, 0, poly, ring, *map(float, (*p, *q))) for g, poly, ring, pts in out for p, q in sides(pts)]


def crossed(lat, lon, e):
    x1, y1, x2, y2 = e[4:]
    return (y2 > lat) != (y1 > lat) and lon < (x1 - x2) * (lat - y2) / (y1 - y2 + 1e-12) + x2


def plain(spots, rows):
    rings = {}
    for e in rows:
        rings.setdefault(e[0], {}).setdefault(e[2], {}).setdefault(e[3], []).append(e)
    odd = lambda lat, lon, ring: sum(crossed(lat, lon, e) for e in ring) % 2
    return {(lat, lon, g) for lat, lon in spots for g, polys in rings.items()
            if any([r for r, ring in sorted(poly.items()) if odd(lat, lon, ring)] == [0] for poly in polys.values())}


def test_cover_agrees_with_the_ray_over_all_edges(spark):
    rng = random.Random(7)
    rows = shapes(rng)
    spots = {(e[5], e[4]) for e in rng.sample(rows, 150)} | {((e[5] + e[7]) / 2, (e[4] + e[6]) / 2) for e in rng.sample(rows, 150)}
    for g in sorted({e[0] for e in rows}):
        own = [e for e in rows if e[0] == g]
        xs, ys = [e[4] for e in own], [e[5] for e in own]
        spots |= {(rng.uniform(min(ys), max(ys)), rng.uniform(min(xs), max(xs))) for _ in range(60)}
    spots |= {(y * 0.125 + 5, x * 0.125 + 10) for x in range(-1, 34) for y in range(-1, 10)}
    spots = {(lat + 0.0, lon + 0.0) for lat, lon in spots}
    points = spark.createDataFrame(sorted(spots), "latitude double, longitude double")
    got = {tuple(r) for r in polygons.containing(points, spark.createDataFrame(rows, EDGE).repartition(5)).collect()}
    assert len(got) > 300
    assert got == plain(spots, rows)


def test_few_edges_are_tested_and_the_cover_follows_the_edges(spark):
    rng = random.Random(3)
    n = 4_000
    ring = [(20 + math.cos(2 * math.pi * i / n) * (8 + rng.random() * 0.1), 30 + math.sin(2 * math.pi * i / n) * 8) for i in range(n)]
    edges = spark.createDataFrame([("b", 0, 0, 0, *p, *q) for p, q in sides(ring)], EDGE)
    points = spark.createDataFrame([(rng.uniform(20, 40), rng.uniform(10, 30)) for _ in range(5_000)], "latitude double, longitude double")
    tested = polygons.met_pieces(points, edges).filter("y is null").count()
    assert tested < 10 * 5_000          # a latitude band alone: about 25 edges a point at this size, and more with more edges
    assert polygons.cover(edges).count() < 6 * n


def test_no_edges_and_unknown_coordinates(spark):
    points = spark.createDataFrame([(1.0, 1.0)], "latitude double, longitude double")
    assert polygons.containing(points, spark.createDataFrame([], EDGE)).count() == 0
    broken = [("a", 0, 0, 0, None, 0.0, 2.0, 2.0), ("a", 0, 0, 0, float("nan"), 0.0, 2.0, 2.0), ("a", 0, 0, 0, 1.0, None, 2.0, 2.0)]
    assert polygons.containing(points, spark.createDataFrame(broken, EDGE)).count() == 0


def test_ablate_leaves_out_features_without_values(spark):
    rows = [(i, "train" if i % 4 else "test", ("gas_flare", "wildfire")[i % 2], float(i % 2), None, "s") for i in range(80)]
    df = spark.createDataFrame(rows, "event_id long, split string, weak_label string, a double, b double, satellite string")
    out = ablate(df, {"one": ["a"], "two": ["a", "b"], "none": ["b"]}, ["satellite"], trees=3, depth=2)
    assert {r["feature_set"] for r in out.filter(F.col("support") > 0).collect()} == {"one", "two", "none"}
    assert out.filter("feature_set = 'two' and f1_delta <> 0").count() == 0
