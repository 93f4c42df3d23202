"""Geodesy and grid keys as column expressions.

The grid is a latitude/longitude grid whose longitude cell count follows the
latitude row (``n = floor(360 * cos(lat) / step)``), so a cell is at least
``step`` degrees of arc wide everywhere, cells tile the circle exactly (the
antimeridian needs no special case) and a polar row degenerates to one cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
EARTH_RADIUS_KM = 6371.0
METRES_PER_DEGREE = 111_320.0

# Relative slack on every angular radius: float noise in a cell key must never lose a neighbour.
_SLACK = 1.0 + 1e-9


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def arc_degrees(metres: float, radius: float = EARTH_RADIUS_M) -> float:
    return math.degrees(metres / radius) * _SLACK


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    """Position on the unit sphere: three trigonometric products per point instead of six per pair."""
    lat, lon = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def chord_squared(a: tuple, b: tuple) -> Column:
    dx, dy, dz = (_c(p) - _c(q) for p, q in zip(a, b))
    return dx * dx + dy * dy + dz * dz


def is_within(radius_m: float, chord2: Column, exact: Column) -> Column:
    """distance <= radius from the squared unit chord; ``exact`` decides only within a part per million of the limit."""
    limit = (2 * math.sin(radius_m / EARTH_RADIUS_M / 2)) ** 2
    return F.when(chord2 < limit * (1 - 1e-6), True).when(chord2 > limit * (1 + 1e-6), False).otherwise(exact <= radius_m)


def edge_crossing(lat, lon, x1, y1, x2, y2) -> Column:
    """Whether an eastward ray from the point crosses the edge (x = lon, y = lat).

    The end points are those of the ring order ``(x1, y1) -> (x2, y2)``; the
    1e-12 nudge in the slope is part of the published result.
    """
    lat, lon, x1, y1, x2, y2 = map(_c, (lat, lon, x1, y1, x2, y2))
    spans = (y2 > lat) != (y1 > lat)
    return spans & (lon < (x1 - x2) * (lat - y2) / (y1 - y2 + F.lit(1e-12)) + x2)


def segment_distance(lat, lon, x1, y1, x2, y2) -> Column:
    """Metres from a point to an edge: foot found on a local plane, length by haversine."""
    lat, lon, x1, y1, x2, y2 = map(_c, (lat, lon, x1, y1, x2, y2))
    scale_x = F.lit(METRES_PER_DEGREE) * F.cos(F.radians((y1 + y2 + lat) / 3.0))
    dx, dy = (x2 - x1) * scale_x, (y2 - y1) * F.lit(METRES_PER_DEGREE)
    px, py = (lon - x1) * scale_x, (lat - y1) * F.lit(METRES_PER_DEGREE)
    norm = dx * dx + dy * dy
    t = F.when(norm == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.nullif(norm, F.lit(0.0)))))
    return haversine(lat, lon, y1 + t * (y2 - y1), x1 + t * (x2 - x1))


# ---------------------------------------------------------------- grid keys

def grid_row(lat, step) -> Column:
    return F.floor(_c(lat) / _c(step)).cast("long")


def _cells_in_row(row: Column, step: Column) -> Column:
    edge = F.greatest(F.abs(row * step), F.abs((row + 1) * step))
    count = F.floor(F.lit(360.0) * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / step)
    return F.greatest(F.lit(1), count).cast("long")


def with_cell(df: DataFrame, lat: str, lon: str, step, row: str = "cy", col: str = "cx") -> DataFrame:
    """Add the one grid cell that holds the point."""
    step = _c(step)
    row_key = grid_row(lat, step)
    count = _cells_in_row(row_key, step)
    col_key = F.pmod(F.floor((F.col(lon) + 180.0) * count / 360.0).cast("long"), count)
    return df.withColumn(row, row_key).withColumn(col, col_key)




def with_cells_in_reach(df: DataFrame, lat: str, lon: str, reach, step,
                        row: str = "cy", col: str = "cx") -> DataFrame:
    """One row per grid cell that can hold a point within ``reach`` degrees of arc.

    Row range is ``lat +- reach``; the column range of each row comes from the
    exact longitude half-width of the spherical cap, so the answer is complete
    at every latitude.
    """
    step, reach = _c(step), _c(reach)
    lat_c, lon_c = F.col(lat), F.col(lon)
    half = F.when(F.abs(lat_c) + reach >= 90.0, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(lat_c))))) * _SLACK)
    out = df.withColumn(
        row, F.explode(F.sequence(grid_row(lat_c - reach, step), grid_row(lat_c + reach, step))))
    count = _cells_in_row(F.col(row), step)
    low = F.floor((lon_c + 180.0 - half) * count / 360.0).cast("long")
    high = F.floor((lon_c + 180.0 + half) * count / 360.0).cast("long")
    full = (high - low + 1) >= count
    out = out.withColumn("_n", count).withColumn(
        "_x", F.explode(F.sequence(F.when(full, F.lit(0).cast("long")).otherwise(low),
                                   F.when(full, count - 1).otherwise(high))))
    return out.withColumn(col, F.pmod(F.col("_x"), F.col("_n"))).drop("_n", "_x")
