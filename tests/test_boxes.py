"""Branch and bound over boxes: complete, and not widened by what lies behind the nearest rim."""

import math
import random

import pytest

from emberline.operators.boxes import near_items

KIND = "g int, ord int, lat double, lon double, reach_m double"


def vector(lat, lon):
    a, b = math.radians(lat), math.radians(lon)
    return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)


def chord(a, b):
    return math.dist(vector(*a), vector(*b))


def found(spark, points, items):
    p = spark.createDataFrame(points, "latitude double, longitude double")
    return near_items(p, spark.createDataFrame(items, KIND), ["g"]).select("latitude", "longitude", "g", "ord").collect()


def test_nearest_item_of_each_group_is_always_among_them(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(90.0, 0.0), (-90.0, 50.0), (0.0, 180.0), (0.0, -180.0), (10.0, 20.0)]
    items = [(rng.randint(0, 2), i, rng.uniform(-90, 90), rng.uniform(-180, 180), 0.0) for i in range(150)]
    items += [(3, 1000 + i, 10 + rng.uniform(-1e-4, 1e-4), 20 + rng.uniform(-1e-4, 1e-4), 0.0) for i in range(200)]          # one dense spot
    items += [(4, 2000, 5.0, 5.0, 0.0), (4, 2001, 5.0, 5.0, 0.0)]                                                              # a tie
    have = {}
    for r in found(spark, points, items):
        have.setdefault((r.latitude, r.longitude, r.g), set()).add(r.ord)
    for p in points:
        for g in range(5):
            own = {i[1]: chord(p, i[2:4]) for i in items if i[0] == g}
            best = {k for k, d in own.items() if d <= min(own.values()) * (1 + 1e-12)}
            assert best <= have[p[0], p[1], g], (p, g)


def test_long_items_take_part_with_their_extent(spark):
    rng = random.Random(8)
    points = [(rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(30)]
    items = [(0, i, rng.uniform(0, 4), rng.uniform(0, 4), rng.choice([0.0, 30.0, 4000.0, 200_000.0])) for i in range(60)]
    have = {}
    for r in found(spark, points, items):
        have.setdefault((r.latitude, r.longitude), set()).add(r.ord)
    for p in points:
        # Whatever point of its extent an item is met at, the item stays if it can be the nearest.
        surely = min(chord(p, i[2:4]) + i[4] / 6_371_008.8 for i in items)
        assert {i[1] for i in items if chord(p, i[2:4]) - i[4] / 6_371_008.8 <= surely - 1e-7} <= have[p]


def test_empty_sides(spark):
    assert found(spark, [], [(0, 1, 1.0, 1.0, 0.0)]) == [] and found(spark, [(1.0, 1.0)], []) == []
    assert found(spark, [(1.0, 1.0)], [(0, 1, None, 1.0, 0.0), (0, 2, 95.0, 1.0, 0.0)]) == []


@pytest.mark.parametrize("place", [(0.0, 0.0), (60.0, 179.0)])
def test_far_dense_cluster_adds_no_candidates(spark, place):
    rng = random.Random(5)
    lat, lon = place
    points = [(lat + 3 + rng.random(), lon + rng.random() - (360 if lon + 1 > 180 else 0)) for _ in range(150)]
    points = [(a, b if b >= -180 else b + 360) for a, b in points]
    def rows(n):
        return len(found(spark, points, [(0, i, lat + rng.random(), lon + rng.random() * 0.9, 0.0) for i in range(n)]))
    few, many = rows(1000), rows(16_000)
    assert many <= 2 * 150 + few and many < 4 * 150, (few, many)


def test_crowded_points_share_the_cells_that_items_ask_for(spark):
    rng = random.Random(11)
    points = [(20 + rng.random() * 0.1, 80 + rng.random() * 0.1) for _ in range(500)]
    items = [(0, i * 20 + k, 15 + i * 0.5, 75 + k * 0.5, 0.0) for i in range(20) for k in range(20)]
    p = spark.createDataFrame(points, "latitude double, longitude double")
    got = near_items(p, spark.createDataFrame(items, KIND), ["g"]).select("latitude", "longitude", "cell", "ord").collect()
    assert len({r.cell for r in got}) <= 4                     # points of one neighbourhood, however many, are few query cells
    assert len(got) == 500                                     # and each takes its own nearest of the cell's candidates
    for r in got:
        assert r.ord == min((chord((r.latitude, r.longitude), i[2:4]), i[1]) for i in items)[1]
