"""Joins against polygon edge tables ``(geom_id, ord, poly, ring, x1, y1, x2, y2)``.

x is longitude, y is latitude; ring 0 is the exterior, other rings are holes.
Rings are closed.  Each geometry is covered by grid cells of its own scale, and
a point meets the pieces of its cell only: the edges that pass through it, and
what all edges further east add to an eastward ray, which is known beforehand.
A point in a cell without edges meets no edge at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.geo import edge_crossing, haversine, segment_distance
from emberline.operators.boxes import near_items
from emberline.operators.proximity import LAT, LON, _closest, locations

_FINEST = -20    # cells are 2**level degrees wide, at least about 0.1 m
_PAD = 1e-9      # degrees; above the rounding error of an edge's longitude at a latitude
_FLAT = 1e-11    # degrees; flatter edges are tested in all cells of their rows


def _grid(level: str, lat: str, lon: str) -> tuple[Column, Column]:
    """(row, column) on the grid of the level; steps are powers of two, so both are exact."""
    step = F.pow(F.lit(2.0), F.col(level))
    return F.floor(F.col(lat) / step).cast("long"), F.floor(F.col(lon) / step).cast("long")


def _usable(edges: DataFrame) -> DataFrame:
    """Edges an eastward ray can cross: not level, all coordinates known."""
    return edges.select("geom_id", "poly", "ring", "x1", "y1", "x2", "y2").filter(
        "y1 <> y2 and x1 + x2 is not null and not isnan(x1 + x2 + y1 + y2)")


def _levels(edges: DataFrame) -> DataFrame:
    """(geom_id, _w, _e, level): a geometry of n edges gets about n cells, so its cover grows with its edges."""
    boxes = edges.groupBy("geom_id").agg(
        F.min(F.least("x1", "x2")).alias("_w"), F.max(F.greatest("x1", "x2")).alias("_e"),
        (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("_h"), F.count(F.lit(1)).alias("_n"))
    wide = F.greatest(F.col("_e") - F.col("_w"), F.col("_h")) / F.sqrt("_n")
    return boxes.select("geom_id", "_w", "_e", F.greatest(F.ceil(F.log2(wide)), F.lit(_FINEST)).cast("int").alias("level"))


def _rows_of_edges(edges: DataFrame) -> DataFrame:
    """Each edge once per grid row it meets, with the columns ``a`` to ``b`` it can pass there."""
    edges = _usable(edges)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = (edges.join(_levels(edges), "geom_id").withColumn("_step", F.pow(F.lit(2.0), F.col("level")))
            .withColumn("cy", F.explode(F.sequence(F.floor(low / F.col("_step")).cast("long"),
                                                   F.floor(high / F.col("_step")).cast("long"))))
            .withColumns({"_low": F.col("cy") * F.col("_step"), "_top": (F.col("cy") + 1) * F.col("_step")}))

    def x_at(y: Column) -> Column:
        y = F.least(F.greatest(y, low), high)
        return F.col("x1") + (F.col("x2") - F.col("x1")) * ((y - F.col("y1")) / (F.col("y2") - F.col("y1")))

    rows = rows.withColumns({"_p": x_at(F.col("_low")), "_q": x_at(F.col("_top"))})
    pad = F.lit(_PAD) + 4e-12 * F.abs(F.col("x1") - F.col("x2")) / F.abs(F.col("y1") - F.col("y2"))
    flat = high - low < _FLAT
    west = F.when(flat, F.col("_w")).otherwise(F.least("_p", "_q") - pad)
    east = F.when(flat, F.col("_e")).otherwise(F.greatest("_p", "_q") + pad)
    return rows.withColumns({"a": F.floor(west / F.col("_step")).cast("long"), "b": F.floor(east / F.col("_step")).cast("long")})


_PIECE = ["level", "cy", "cx", "geom_id", "poly", "ring", "y", "x1", "y1", "x2", "y2"]


def cover(edges: DataFrame) -> DataFrame:
    """Pieces of each geometry by cell ``(level, cy, cx)``; the ray of a point in the cell crosses

    * an edge (``x1 .. y2``) if ``edge_crossing`` says so,
    * a level piece (``y``; infinite for the whole cell) if the point lies below it.

    Edges east of a cell are crossed wherever they span the latitude, whatever
    the longitude: each end above the point counts once.  Ends at one height of
    one ring are sorted by the column their edge begins in, and every second gap
    between them is a run of cells where an odd number of them is left.
    """
    rows = _rows_of_edges(edges)
    nothing = F.lit(None).cast("double")
    tested = rows.withColumns({"cx": F.explode(F.sequence("a", "b")), "y": nothing})
    ends = (rows.withColumn("y", F.explode(F.array("y1", "y2"))).filter("y > _low")
            .withColumn("y", F.when(F.col("y") >= F.col("_top"), F.lit(float("inf"))).otherwise(F.col("y"))))
    heights = Window.partitionBy("geom_id", "poly", "ring", "level", "cy", "y").orderBy(F.desc("a"))
    runs = ends.withColumns({"_i": F.row_number().over(heights), "_from": F.lead("a").over(heights)}).withColumn(
        "_from", F.coalesce("_from", F.floor(F.col("_w") / F.col("_step")).cast("long")))
    levels = (runs.filter("_i % 2 = 1 and _from < a").withColumn("cx", F.explode(F.sequence(F.col("_from"), F.col("a") - 1)))
              .withColumns({c: nothing for c in ("x1", "y1", "x2", "y2")}))
    return tested.select(*_PIECE).unionByName(levels.select(*_PIECE))


def met_pieces(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points (latitude, longitude) beside the pieces of their cells."""
    pieces = cover(edges)
    used = sorted(r[0] for r in _levels(_usable(edges)).select("level").distinct().collect())   # at most 29 numbers
    spots = points.select(LAT, LON).withColumn("level", F.explode(F.array(*[F.lit(k) for k in used or [0]])))
    cy, cx = _grid("level", LAT, LON)
    return spots.withColumns({"cy": cy, "cx": cx}).join(pieces, ["level", "cy", "cx"])


def containing(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(latitude, longitude, geom_id) for every geometry that contains the point.

    The point is in some polygon's exterior ring and in none of its holes.
    """
    keys = [LAT, LON, "geom_id"]
    crossed = F.coalesce(F.col("y") > F.col(LAT), edge_crossing(LAT, LON, "x1", "y1", "x2", "y2"))
    rings = (met_pieces(points, edges).filter(crossed)
             .groupBy(*keys, "poly", "ring").agg((F.count(F.lit(1)) % 2).alias("_odd")).filter("_odd = 1"))
    return (rings.groupBy(*keys, "poly").agg(F.min("ring").alias("_out"), F.max("ring").alias("_hole"))
            .filter("_out = 0 and _hole = 0").select(*keys).distinct())


def inside_boundary(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``inside`` (boolean) for one boundary; malformed coordinates count as outside."""
    hits = containing(locations(events), edges.withColumn("geom_id", F.lit(0))).select(LAT, LON)
    return events.join(hits.withColumn("_in", F.lit(True)), [LAT, LON], "left").select(
        *events.columns, F.coalesce("_in", F.lit(False)).alias("inside"))


def clip(events: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (inside, outside); all columns kept, every row on exactly one side."""
    flagged = inside_boundary(events, edges)
    return flagged.filter("inside").drop("inside"), flagged.filter("not inside").drop("inside")


def landcover_of(events: DataFrame, landcover: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``landcover_class``: class of the first polygon in list order that holds the point, else unknown."""
    hits = containing(locations(events), edges).join(landcover.select("geom_id", "ord", "class"), "geom_id")
    first = hits.groupBy(LAT, LON).agg(F.min_by("class", "ord").alias("_class"))
    return events.join(first, [LAT, LON], "left").select(
        *events.columns, F.coalesce("_class", F.lit("unknown")).alias("landcover_class"))


def _as_items(edges: DataFrame, payload: list[str]) -> DataFrame:
    """Exterior edges as centre plus extent, for the nearest-candidate search (holes do not count)."""
    mid_lat, mid_lon = (F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2
    # Every point of the edge is within the longer half; the margin covers the bend of a parallel.
    reach = F.greatest(haversine(mid_lat, mid_lon, F.col("y1"), F.col("x1")),
                       haversine(mid_lat, mid_lon, F.col("y2"), F.col("x2"))) * 1.01 + 1.0
    return edges.filter("ring = 0").select(
        mid_lat.alias("lat"), mid_lon.alias("lon"), reach.alias("reach_m"), *payload, "x1", "y1", "x2", "y2")


def distance_to_classes(events: DataFrame, landcover: DataFrame, edges: DataFrame,
                        classes: dict[str, str]) -> DataFrame:
    """Add metres to the nearest polygon of each class (0 inside, NULL when the class is absent).

    ``classes`` maps the new column to the land-cover class.
    """
    wanted = landcover.filter(F.col("class").isin(list(classes.values()))).select("geom_id", "class")
    chosen = edges.join(wanted, "geom_id")
    spots = locations(events)
    near = (near_items(spots, _as_items(chosen, ["class"]), ["class"])
            .withColumn("_d", segment_distance(LAT, LON, "x1", "y1", "x2", "y2"))
            .groupBy(LAT, LON, "class").agg(F.min("_d").alias("_d")))
    inside = (containing(spots, chosen.drop("class")).join(wanted, "geom_id")
              .select(LAT, LON, "class", F.lit(0.0).alias("_d")))
    wide = near.unionByName(inside).groupBy(LAT, LON).agg(
        *[F.min(F.when(F.col("class") == cls, F.col("_d"))).alias(name) for name, cls in classes.items()])
    return events.join(wide, [LAT, LON], "left").select(*events.columns, *classes)


def nearest_geometry(events: DataFrame, facilities: DataFrame, edges: DataFrame) -> DataFrame:
    """Nearest facility over points and polygons, with ``inside_industrial_area``.

    ``facilities``: ord, facility_id, name, facility_type, geom_type, lat, lon
    (coordinates of point facilities only); ``edges`` carries the polygons, keyed
    by facility_id in ``geom_id``.  Inside a polygon is distance 0; a point
    winner is never "inside"; NULL without facilities.
    """
    dims = facilities.select("ord", "facility_id", "name", "facility_type", "geom_type")
    no_edge = [F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    points = facilities.filter("geom_type = 'Point'").select("lat", "lon", F.lit(0.0).alias("reach_m"), "ord", *no_edge)
    owners = dims.select("ord", F.col("facility_id").alias("geom_id"))
    sides = _as_items(edges.drop("ord").join(owners, "geom_id"), ["ord"])
    items = points.unionByName(sides).withColumn("_g", F.lit(0))
    spots = locations(events)
    near = near_items(spots, items, ["_g"]).withColumn("distance_m", F.when(
        F.col("x1").isNull(), haversine(LAT, LON, "lat", "lon")).otherwise(
        segment_distance(LAT, LON, "x1", "y1", "x2", "y2"))).select(LAT, LON, "ord", "distance_m")
    inside = (containing(spots, edges).join(owners, "geom_id")
              .select(LAT, LON, "ord", F.lit(0.0).alias("distance_m")))
    best = near.unionByName(inside).groupBy(LAT, LON).agg(_closest("ord").alias("_best"))
    best = best.select(LAT, LON, F.col("_best.ord").alias("ord"), F.col("_best.distance_m").alias("distance_m"))
    best = best.join(dims, "ord")
    return events.join(best, [LAT, LON], "left").select(
        *events.columns, F.col("facility_id").alias("nearest_facility_id"),
        F.col("name").alias("nearest_facility_name"), "facility_type",
        F.col("distance_m").alias("distance_to_facility_m"),
        F.when(F.col("geom_type").isNotNull(),
               (F.col("geom_type") != "Point") & (F.col("distance_m") == 0)).alias("inside_industrial_area"))
