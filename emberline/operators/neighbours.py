"""Counts of earlier (or surrounding) detections near every detection.

Ordinary places use a grid equi-join.  A place so busy that its pairs would
swamp one task (a persistent source may own a third of the archive) takes a
second, exact way that does not enumerate its pairs: the place is divided into
fine sub-cells, and for every pair of sub-cells the extents tell whether all,
none or some of the point pairs are within the radius.  "All" is answered from
per-sub-cell time series (see ``timeline``); only "some" is tested point by
point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import (EARTH_RADIUS_M, arc_degrees, chord_squared, haversine, is_within, unit_vector,
                                     with_cell, with_cells_in_reach)
from emberline.operators.proximity import LAT, LON
from emberline.operators.timeline import DAY_US, Span, around, past, span_counts
from emberline.session import cut

# Point pairs a single grid cell may produce before the dense way takes over.
DENSE_PAIRS = 64_000_000
_FINE = 32          # sub-cells per cell edge on the dense way
# Cells are this many radii wide, so a history row is copied to about four of them.
_CELL = 2


@dataclass(frozen=True)
class NearCount:
    """Detections within ``radius_m``; at most ``days`` apart, or at any time when ``None``."""

    name: str
    radius_m: float
    days: float | None = None


def _points(df: DataFrame, lat: str, lon: str, ts: str, same: str | None) -> DataFrame:
    """Identical observations collapse to a weight: copies cannot make pairs."""
    by = [] if same is None else [F.col(same).alias("_same")]
    return (df.filter(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & F.col(ts).isNotNull())
            .groupBy(*by, F.col(lat).alias(LAT), F.col(lon).alias(LON), F.unix_micros(ts).alias("at"))
            .agg(F.count(F.lit(1)).alias("n")))


def _in_time(count: NearCount, symmetric: bool) -> Column:
    gap = F.col("at") - F.col("h_at")
    if symmetric:
        return F.lit(True) if count.days is None else F.abs(gap) <= int(count.days * DAY_US)
    return (gap > 0) if count.days is None else (gap > 0) & (gap <= int(count.days * DAY_US))


def _any_time(counts: list[NearCount], symmetric: bool) -> Column:
    """The widest time condition of all counts."""
    widest = next((c for c in counts if c.days is None), max(counts, key=lambda c: c.days or 0))
    return _in_time(widest, symmetric)


def _pair_counts(pairs: DataFrame, counts: list[NearCount], symmetric: bool, keys: list[str],
                 only: dict[str, Column] | None = None) -> DataFrame:
    exact = haversine(LAT, LON, "h_lat", "h_lon")
    near = pairs.withColumn("_c2", chord_squared(("ux", "uy", "uz"), ("h_ux", "h_uy", "h_uz")))
    near = near.filter(is_within(max(c.radius_m for c in counts), F.col("_c2"), exact))
    aggs = []
    for c in counts:
        hit = is_within(c.radius_m, F.col("_c2"), exact) & _in_time(c, symmetric)
        if only:
            hit = hit & only[c.name]
        aggs.append(F.sum(F.when(hit, F.col("h_n"))).alias(c.name))
    return near.groupBy(*keys).agg(*aggs)


def _with_vector(df: DataFrame, lat: str, lon: str, prefix: str) -> DataFrame:
    return df.withColumns(dict(zip((f"{prefix}ux", f"{prefix}uy", f"{prefix}uz"), unit_vector(lat, lon))))


def near_counts(events: DataFrame, history: DataFrame, counts: list[NearCount], symmetric: bool = False,
                lat: str = LAT, lon: str = LON, ts: str = "ts", dense_pairs: int = DENSE_PAIRS,
                same: str | None = None) -> DataFrame:
    """Add one column per count to ``events``: history detections near each event.

    Past mode counts strictly earlier history only (simultaneous detections and
    the event itself never count).  Symmetric mode counts both sides of the
    event's own table and leaves the event itself out.  ``lat``/``lon`` name the
    event-side position (for example its facility); history uses
    latitude/longitude/``ts``.  With ``same``, a column of both tables, only
    history with the event's value there counts (none for NULL).
    """
    by = [] if same is None else ["_same"]
    reach = arc_degrees(max(c.radius_m for c in counts))
    step = _CELL * reach
    left = _with_vector(with_cell(_points(events, lat, lon, ts, same), LAT, LON, step), LAT, LON, "")
    right = _points(history, LAT, LON, "ts", same).select(
        *by, F.col(LAT).alias("h_lat"), F.col(LON).alias("h_lon"), F.col("at").alias("h_at"), F.col("n").alias("h_n"))
    own_cells = with_cell(right, "h_lat", "h_lon", step)
    right = with_cells_in_reach(_with_vector(right, "h_lat", "h_lon", "h_"), "h_lat", "h_lon", reach, step)

    finite = all(c.days is not None for c in counts)
    # Rows copied to cells are many times what Catalyst expects of their files: they are merged, never broadcast.
    cell = ["cy", "cx", *by]
    if finite:
        # Bounded windows: a time bucket in the key keeps a long archive from meeting itself.
        width = int(max(c.days for c in counts) * DAY_US)
        bucket = F.floor(F.col("h_at") / F.lit(width)).cast("long")
        left = left.withColumn("tb", F.floor(F.col("at") / F.lit(width)).cast("long"))
        own_cells = own_cells.withColumn("tb", bucket)
        right = right.withColumn("tb", F.explode(F.sequence(bucket - (1 if symmetric else 0), bucket + 1)))
        cell = [*cell, "tb"]

    busy_cells = None
    # Cheap bound first: no history cell reaches more than 12 cells and 3 time buckets.
    if _largest(left, cell) * _largest(own_cells, cell) * (36 if finite else 12) > dense_pairs:
        busy_cells = cut(left.groupBy(*cell).agg(F.count(F.lit(1)).alias("_l"))
                         .join(right.groupBy(*cell).agg(F.count(F.lit(1)).alias("_r")), cell)
                         .filter(F.col("_l").cast("double") * F.col("_r") > dense_pairs).select(*cell))
        busy_cells = None if busy_cells.isEmpty() else busy_cells
    point = [LAT, LON, "at"]
    possible = _any_time(counts, symmetric) & (F.abs(F.col(LAT) - F.col("h_lat")) <= reach)
    if busy_cells is None:
        found = _pair_counts(left.join(right.hint("merge"), cell).filter(possible),
                             counts, symmetric, [*cell, *point])
    else:
        calm_l, calm_r = left.join(busy_cells, cell, "left_anti"), right.join(busy_cells, cell, "left_anti")
        calm = _pair_counts(calm_l.join(calm_r.hint("merge"), cell).filter(possible),
                            counts, symmetric, [*cell, *point])
        # The busy rows are read several times: written once, they also survive lost executors.
        busy = _dense(cut(left.join(busy_cells, cell, "left_semi")), cut(right.join(busy_cells, cell, "left_semi")),
                      cell, counts, symmetric, step / _FINE)
        found = calm.unionByName(busy)
    found = found.drop(*[c for c in cell if c not in by])

    zero = F.lit(0).cast("long")
    own = F.lit(1).cast("long") if symmetric else zero
    keyed = events.withColumn("_at", F.unix_micros(ts))
    found = found.select(*by, F.col(LAT).alias("_la"), F.col(LON).alias("_lo"), F.col("at").alias("_t"),
                         *[F.col(c.name).alias(f"_{c.name}") for c in counts])
    matched = (F.col(lat) == F.col("_la")) & (F.col(lon) == F.col("_lo")) & (F.col("_at") == F.col("_t"))
    if by:
        matched = matched & (keyed[same] == F.col("_same"))
    joined = keyed.join(found, matched, "left")
    return joined.select(*events.columns, *[
        F.greatest(zero, F.coalesce(F.col(f"_{c.name}"), zero) - own).cast("long").alias(c.name) for c in counts])


def _largest(df: DataFrame, cell: list[str]) -> int:
    """Rows of the fullest cell: one small aggregate."""
    return df.groupBy(*cell).count().agg(F.max("count")).first()[0] or 0


def _boxes(df: DataFrame, keys: list[str], lat: str, lon: str, prefix: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(lat).alias(f"{prefix}s"), F.max(lat).alias(f"{prefix}n"),
        F.min(lon).alias(f"{prefix}w"), F.max(lon).alias(f"{prefix}e"))


def box_distance_bounds() -> tuple[Column, Column]:
    """Rigorous lower and upper bound (metres) on the distance of points of box ``a_`` and box ``b_``.

    The haversine argument grows with both coordinate differences (under half a
    turn), so the nearest and farthest differences bound it; cosines are taken at
    the extreme latitudes.
    """
    a_s, a_n, a_w, a_e = (F.col(f"a_{k}") for k in "snwe")
    b_s, b_n, b_w, b_e = (F.col(f"b_{k}") for k in "snwe")
    mid = (b_w + b_e) / 2 - (a_w + a_e) / 2
    turn = F.when(mid > 180, F.lit(-360.0)).when(mid < -180, F.lit(360.0)).otherwise(F.lit(0.0))
    b_w, b_e = b_w + turn, b_e + turn
    d_lat = F.greatest(F.lit(0.0), b_s - a_n, a_s - b_n)
    d_lon = F.greatest(F.lit(0.0), b_w - a_e, a_w - b_e)
    far_lat = F.greatest(b_n - a_s, a_n - b_s)
    far_lon = F.least(F.lit(180.0), F.greatest(b_e - a_w, a_e - b_w))

    def steepest(s: Column, n: Column) -> Column:
        return F.cos(F.radians(F.greatest(F.abs(s), F.abs(n))))

    def flattest(s: Column, n: Column) -> Column:
        return F.cos(F.radians(F.when(s * n <= 0, F.lit(0.0)).otherwise(F.least(F.abs(s), F.abs(n)))))

    def arc(dy: Column, dx: Column, cosines: Column) -> Column:
        sy, sx = F.sin(F.radians(dy) / 2), F.sin(F.radians(dx) / 2)
        return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), sy * sy + cosines * sx * sx)))

    low = arc(d_lat, d_lon, steepest(a_s, a_n) * steepest(b_s, b_n)) * (1 - 1e-9) - 1e-6
    high = arc(far_lat, far_lon, flattest(a_s, a_n) * flattest(b_s, b_n)) * (1 + 1e-9) + 1e-6
    return low, high


def _dense(left: DataFrame, right: DataFrame, cell: list[str], counts: list[NearCount], symmetric: bool,
           fine: float) -> DataFrame:
    """The counts of busy cells from sub-cell series plus a point test along the radius only."""
    left = with_cell(left, LAT, LON, fine, "ay", "ax")
    right = with_cell(right, "h_lat", "h_lon", fine, "by", "bx")
    a_key, b_key = [*cell, "ay", "ax"], [*cell, "by", "bx"]
    # Sub-cells per busy cell are bounded by the geometry, whatever the number of detections.
    low, high = box_distance_bounds()
    sub = (_boxes(left, a_key, LAT, LON, "a_").join(_boxes(right, b_key, "h_lat", "h_lon", "b_"), cell)
           .withColumn("_lo", low).withColumn("_hi", high)
           .filter(F.col("_lo") <= max(c.radius_m for c in counts)))
    sub = cut(sub.select(
        *a_key, "by", "bx", *[(F.col("_hi") <= c.radius_m).alias(f"in_{c.name}") for c in counts],
        *[((F.col("_hi") > c.radius_m) & (F.col("_lo") <= c.radius_m)).alias(f"edge_{c.name}")
          for c in counts]))

    def any_of(kind: str) -> Column:
        hit = F.lit(False)
        for c in counts:
            hit = hit | F.col(f"{kind}_{c.name}")
        return hit

    # Whole sub-cells: (sub-cell, instant) weights, then interval sums on the summed series.
    series = right.groupBy(*b_key, F.col("h_at").alias("at")).agg(F.sum("h_n").alias("n"))
    whole = (sub.filter(any_of("in")).join(series.hint("merge"), b_key).groupBy(*a_key, "at")
             .agg(*[F.sum(F.when(F.col(f"in_{c.name}"), F.col("n")).otherwise(F.lit(0))).alias(f"n_{c.name}")
                    for c in counts]))
    make = around if symmetric else past
    spans: list[Span] = [make(c.name, c.days, f"n_{c.name}") for c in counts]
    whole = span_counts(whole, left.select(*a_key, "at").distinct(), a_key, spans)
    inner = left.select(*a_key, LAT, LON, "at").join(whole.hint("merge"), [*a_key, "at"]).drop("ay", "ax")

    # Sub-cells cut by the radius: point test, restricted to the counts they are undecided for.
    edge = (sub.filter(any_of("edge")).select(*a_key, "by", "bx", *[f"edge_{c.name}" for c in counts])
            .join(left.drop("n").hint("merge"), a_key).join(right.hint("merge"), b_key))
    rim = _pair_counts(edge, counts, symmetric, [*cell, LAT, LON, "at"],
                       {c.name: F.col(f"edge_{c.name}") for c in counts})
    return inner.unionByName(rim).groupBy(*cell, LAT, LON, "at").agg(
        *[F.sum(c.name).cast("long").alias(c.name) for c in counts])
