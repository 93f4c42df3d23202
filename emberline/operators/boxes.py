"""Nearest-item search by branch and bound over two hierarchies of bounding boxes.

Positions are unit vectors, so the antimeridian and the poles are ordinary places
and chord length orders distances as arc length does.  Both sides are kept as a
tree: at every level of a grid over the cube around the globe, each occupied cell
has the tight box of what lies in it.  The descent holds pairs of a query cell and
an item cell.  From level to level both are replaced by their children; the least
upper bound over a query cell's pairs says how far its nearest item can be at most,
and pairs that can't come that near are dropped.  Every step is two equality joins on
the parents' keys around one aggregate, which collects the item cells that a query
cell meets: they are few, and its children take what they need from its row.  What
survives is the rim at about the nearest distance, a few cells wide, however many
items lie behind it.  Last, every point takes its own candidates from its cell's.

Items may have an extent (``reach_m`` around their centre).  They stay at the level
whose cells match it, apart from smaller ones, so a few long items widen no other
item's box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import EARTH_RADIUS_M, unit_vector
from emberline.session import cut

#: Levels of the grid (2^-21 of the cube is 6 m), levels of one step, items of a cell at the last level,
#: and the first level (25 km) that may be the last one: points are dealt out by its cells.
DEEPEST, STRIDE, LEAF_ITEMS, SHALLOWEST = 21, 3, 8, 9
#: Room for rounding in unit coordinates (about 6 mm).
SLACK = 1e-9
_AXES = ("x", "y", "z")


def _corner(axis: str) -> Column:
    """Cell number along an axis at the deepest level."""
    return F.least(F.floor((F.col(f"_{axis}") + 1.0) * float(1 << (DEEPEST - 1))), F.lit((1 << DEEPEST) - 1)).cast("long")


def _key(level: int) -> Column:
    """One number for the cell of a level, from the cell numbers at the deepest level."""
    x, y, z = (F.shiftright(f"_c{a}", DEEPEST - level) for a in _AXES)
    return F.shiftleft(x, 2 * DEEPEST) + F.shiftleft(y, DEEPEST) + z


def _placed(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Add the unit vector (_x, _y, _z) and the deepest cell (_cx, _cy, _cz)."""
    at = unit_vector(lat, lon)
    out = df.select("*", *[v.alias(f"_{a}") for a, v in zip(_AXES, at)])
    return out.select("*", *[_corner(a).alias(f"_c{a}") for a in _AXES])


def _box(low: str = "_l", high: str = "_h") -> list[Column]:
    return [f(F.col(f"{c}{a}")).alias(f"{c}{a}") for a in _AXES for f, c in ((F.min, low), (F.max, high))]


def _at_levels(cells: DataFrame, levels: list[int], by: list[str]) -> DataFrame:
    """The box and the weight of every occupied cell of the levels, with the key of its parent."""
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), _key(n).alias("key"), _key(max(0, n - STRIDE)).alias("parent")) for n in levels]))
    boxes = [f"_{c}{a}" for a in _AXES for c in "lh"]
    flat = cells.select(*by, *boxes, "_n", kinds.alias("_k")).select(*by, *boxes, "_n", "_k.level", "_k.key", "_k.parent")
    return flat.groupBy(*by, "level", "key", "parent").agg(*_box(), F.sum("_n").alias("_n"))


def _named(df: DataFrame, prefix: str) -> list[Column]:
    return [F.col(f"_{c}{a}").alias(f"{prefix}_{c}{a}") for a in _AXES for c in "lh"]


def _length(sides: list[Column]) -> Column:
    # A power names its side once: inside a function nothing that is written twice is shared.
    return F.sqrt(sum((F.pow(d, F.lit(2.0)) for d in sides[1:]), F.pow(sides[0], F.lit(2.0))))


def _from_box(n: Column) -> tuple[Column, Column]:
    """Least and greatest chord between the row's box (``q_``) and a box."""
    gap = [F.greatest(F.lit(0.0), F.col(f"q_l{a}") - n[f"h{a}"], n[f"l{a}"] - F.col(f"q_h{a}")) for a in _AXES]
    span = [F.greatest(F.col(f"q_h{a}") - n[f"l{a}"], n[f"h{a}"] - F.col(f"q_l{a}")) for a in _AXES]
    return _length(gap), _length(span)


def _from_point(n: Column) -> tuple[Column, Column]:
    """Chord between the row's point (``q_``) and an item's centre, and the item's extent."""
    return _length([F.col(f"q_{a}") - n[a] for a in _AXES]), n["extent"]


def _pruned(rows: DataFrame, keep: list[str], point: bool = False) -> DataFrame:
    """``keep`` and ``n``: what in a row's array ``_near`` can come as near to its box or point as one of them surely does.

    All that competes for a query cell lies in its row, so what is dropped is never shuffled.
    """
    def measured(n: Column) -> Column:
        a, b = _from_point(n) if point else _from_box(n)
        return F.struct(n.alias("n"), a.alias("a"), b.alias("b"))

    rows = rows.withColumn("_b", F.transform("_near", measured))
    # The slack keeps ties and rounding; as the variable of a function the bound is worked out once a row.
    best = F.array_min(F.transform("_b", lambda b: b["a"] + b["b"] if point else b["b"])) + SLACK
    near = F.flatten(F.transform(F.array(best), lambda most: F.filter("_b", lambda b: (b["a"] - b["b"] if point else b["a"]) <= most)))
    return rows.select(*keep, F.explode(near).alias("_b")).select(*keep, "_b.n")


def near_items(points: DataFrame, items: DataFrame, group: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Every point with, for each group, the items that may be its nearest: all that tie for it are there.

    ``items``: lat, lon (centre), ``reach_m``, the group columns and payload.  The result has the columns of ``points``,
    ``cell`` (the query cell, a function of the coordinates), the group and the item columns.
    """
    extent = F.col("reach_m") / EARTH_RADIUS_M
    kind = F.when(F.col("reach_m") > 0, F.floor(-F.log2(extent) / STRIDE) * STRIDE).otherwise(F.lit(DEEPEST))
    spots = _placed(items.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)), "lat", "lon")
    spots = spots.withColumn("_kind", F.greatest(F.lit(0), F.least(F.lit(DEEPEST), kind)).cast("int"))
    # Long items don't go below the level of their extent.
    spots = spots.select(*[c for c in spots.columns if not c.startswith("_c")],
                         *[F.expr(f"shiftleft(shiftright(_c{a}, {DEEPEST} - _kind), {DEEPEST} - _kind)").alias(f"_c{a}") for a in _AXES],
                         *[f.alias(f"_{c}{a}") for a in _AXES
                           for c, f in (("l", F.col(f"_{a}") - extent - SLACK), ("h", F.col(f"_{a}") + extent + SLACK))])
    finest = spots.groupBy(*group, "_kind", *[f"_c{a}" for a in _AXES]).agg(*_box(), F.count(F.lit(1)).alias("_n"))
    levels = list(range(0, DEEPEST + 1, STRIDE))
    nodes = cut(_at_levels(finest, levels, [*group, "_kind"]))
    crowd = {r["level"]: r["n"] for r in nodes.filter("_kind >= level").groupBy("level").agg(F.max("_n").alias("n")).collect()}   # a row for each level
    last = max(SHALLOWEST, next((n for n in levels if crowd.get(n, 0) <= LEAF_ITEMS), DEEPEST))

    asked = _placed(points, lat, lon).withColumn("cell", _key(last))
    ends = [f.alias(f"_{c}{a}") for a in _AXES for c, f in (("l", F.col(f"_{a}")), ("h", F.col(f"_{a}")))]
    occupied = asked.select("cell", *[F.expr(f"shiftleft(shiftright(_c{a}, {DEEPEST - last}), {DEEPEST - last})").alias(f"_c{a}") for a in _AXES], *ends)
    occupied = occupied.groupBy("cell", *[f"_c{a}" for a in _AXES]).agg(*_box(), F.lit(1).alias("_n"))
    cells = cut(_at_levels(occupied, [n for n in levels if n <= last], []))

    pairs = cells.filter("level = 0").select(F.col("key").alias("qkey")).join(
        nodes.filter("level = 0").select(*group, "_kind", F.col("key").alias("nkey")), F.col("qkey") == F.col("nkey"))
    for level in levels[1:levels.index(last) + 1]:
        below = nodes.filter(F.col("level") == level).select(
            *group, "_kind", F.col("parent").alias("nkey"),
            F.struct("_kind", F.col("key").alias("nkey"), *[F.col(f"_{c}{a}").alias(f"{c}{a}") for a in _AXES for c in "lh"]).alias("n"))
        queries = cells.filter(F.col("level") == level).select(F.col("key").alias("qkey"), F.col("parent").alias("qparent"), *_named(cells, "q"))
        met = pairs.join(below, [*group, "_kind", "nkey"]).groupBy(F.col("qkey").alias("qparent"), *group).agg(F.collect_list("n").alias("_near"))
        pairs = _pruned(met.join(queries, "qparent"), [*group, "qkey"]).select(*group, "qkey", "n._kind", "n.nkey")
    leaves = spots.withColumn("nkey", _key(last)).select(*group, "_kind", "nkey", F.struct(
        F.struct(*items.columns).alias("item"), *[F.col(f"_{a}").alias(a) for a in _AXES], (extent + SLACK).alias("extent")).alias("n"))
    met = pairs.join(leaves, [*group, "_kind", "nkey"]).groupBy(F.col("qkey").alias("cell"), *group).agg(F.collect_list("n").alias("_near"))
    # The points themselves are the last query boxes.
    spot = dict(zip(_AXES, unit_vector(lat, lon)))
    near = asked.select(*points.columns, "cell").join(met, "cell").withColumns({f"q_{a}": spot[a] for a in _AXES})
    return _pruned(near, [*points.columns, "cell"], point=True).select(*points.columns, "cell", "n.item.*")
