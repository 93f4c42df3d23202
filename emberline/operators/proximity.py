"""Distance joins between detections and reference points.

Joins inside a radius are equi-joins on grid cells, joins without one descend trees of boxes (``boxes``).  Detections are first reduced to their
distinct coordinates (all results depend on the coordinates only), so repeated
detections of one source, however many, cost one row; the result is joined back
so that every input row is kept exactly once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.geo import EARTH_RADIUS_M, arc_degrees, haversine, with_cell, with_cells_in_reach
from emberline.operators.boxes import near_items

LAT, LON = "latitude", "longitude"


def locations(df: DataFrame, lat: str = LAT, lon: str = LON) -> DataFrame:
    """Distinct valid coordinates."""
    return (df.select(F.col(lat).alias(LAT), F.col(lon).alias(LON))
            .filter(F.col(LAT).between(-90, 90) & F.col(LON).between(-180, 180)).distinct())


def pairs_within(points: DataFrame, targets: DataFrame, radius_m: float) -> DataFrame:
    """Every (point, target) pair at most ``radius_m`` apart, with ``distance_m``.

    ``points`` has latitude/longitude; ``targets`` has lat/lon plus payload.
    Targets, the smaller side, are copied to the cells in reach (9 on average);
    points keep one cell.  Both sides are shuffled by cell: the copies are many
    times what Catalyst expects of the targets' files, so they are never broadcast.
    """
    reach = arc_degrees(radius_m)
    left = with_cell(points, LAT, LON, reach)
    right = with_cells_in_reach(
        targets.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)),
        "lat", "lon", reach, reach)
    near = left.join(right.hint("merge"), ["cy", "cx"]).filter(F.abs(F.col(LAT) - F.col("lat")) <= reach)
    return (near.withColumn("distance_m", haversine(LAT, LON, "lat", "lon"))
            .filter(F.col("distance_m") <= radius_m))


def within_context(events: DataFrame, targets: DataFrame, radius_m: float, aggs: list[Column]) -> DataFrame:
    """Aggregate the targets within the radius of every event; one row in, one row out."""
    near = pairs_within(locations(events), targets, radius_m)
    # cy/cx are a function of the coordinates: naming them keeps the join's partitioning.
    found = near.groupBy("cy", "cx", LAT, LON).agg(*aggs).drop("cy", "cx")
    return events.join(found, [LAT, LON], "left")


def _closest(*payload: str) -> Column:
    """Payload of the nearest target, ties to the lowest ordinal."""
    return F.min_by(F.struct("distance_m", *payload), F.struct("distance_m", "ord"))


def nearest_within(events: DataFrame, facilities: DataFrame, radius_m: float = 5000.0) -> DataFrame:
    """Nearest facility inside the radius; NULL beyond it, plus a 0/1 presence flag."""
    best = _closest("facility_id", "name", "facility_type").alias("_best")
    out = within_context(events, facilities, radius_m, [best])
    return out.select(
        *events.columns,
        F.col("_best.distance_m").alias("nearest_facility_distance_m"),
        F.col("_best.facility_type").alias("nearest_facility_type"),
        F.col("_best.facility_id").alias("nearest_facility_id"),
        F.col("_best.name").alias("nearest_facility_name"),
        F.col("_best").isNotNull().cast("int").alias("nearest_facility_present"))


def nearest_by_type(events: DataFrame, facilities: DataFrame, types: list[str],
                    radius_m: float = 5000.0) -> DataFrame:
    """Nearest distance per facility type inside the radius, with presence flags."""
    aggs = [F.min(F.when(F.col("facility_type") == t, F.col("distance_m"))).alias(f"nearest_{t}_distance_m")
            for t in types]
    out = within_context(events, facilities, radius_m, aggs)
    flags = [F.col(f"nearest_{t}_distance_m").isNotNull().cast("int").alias(f"nearest_{t}_present") for t in types]
    return out.select(*events.columns, *[f"nearest_{t}_distance_m" for t in types], *flags)


def _weighted(targets: DataFrame) -> DataFrame:
    """Facilities at one spot with one type collapse to a weight before anything is joined."""
    return targets.groupBy("lat", "lon", "facility_type").agg(F.count(F.lit(1)).alias("_weight"))


def radius_counts(events: DataFrame, facilities: DataFrame,
                  counts: list[tuple[str, float, set[str] | None]]) -> DataFrame:
    """Facility counts per (column, radius, type set or None for all types); 0 when nothing is near."""
    aggs = []
    for name, radius, types in counts:
        hit = F.col("distance_m") <= radius
        if types is not None:
            hit = hit & F.col("facility_type").isin(sorted(types))
        aggs.append(F.sum(F.when(hit, F.col("_weight"))).alias(name))
    reach = max(radius for _, radius, _ in counts)
    out = within_context(events, _weighted(facilities), reach, aggs)
    return out.select(*events.columns,
                      *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n, _, _ in counts])


def within_radius(events: DataFrame, facilities: DataFrame, radius_m: float) -> DataFrame:
    """Listing: one row per (event, facility) pair inside the radius."""
    near = pairs_within(locations(events), facilities, radius_m).drop("cy", "cx")
    return events.join(near, [LAT, LON])


# ---------------------------------------------------------- unbounded nearest

def nearest_points(events: DataFrame, items: DataFrame, payload: list[str], group: list[str],
                   radius: float = EARTH_RADIUS_M) -> DataFrame:
    """Nearest point item per distinct event coordinate and group: a struct column ``best``, and the coordinate's ``cell``.

    Items need lat, lon, ord, the payload and the group columns; ties go to the lowest ``ord``.
    """
    # Only the first item of each spot and group can win.
    first = items.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).groupBy(
        "lat", "lon", *group).agg(F.min_by(F.struct("ord", *payload), "ord").alias("_item"))
    first = first.select("lat", "lon", *group, F.col("_item.ord").alias("ord"),
                         *[F.col(f"_item.{p}").alias(p) for p in payload], F.lit(0.0).alias("reach_m"))
    pairs = near_items(locations(events), first, group)
    pairs = pairs.withColumn("distance_m", haversine(LAT, LON, "lat", "lon", radius))
    # The cell is a function of the coordinates: naming it keeps the join's partitioning, also in further aggregates.
    return pairs.groupBy("cell", LAT, LON, *group).agg(
        F.min_by(F.struct("distance_m", "ord", *payload), F.struct("distance_m", "ord")).alias("best"))


def nearest(events: DataFrame, facilities: DataFrame) -> DataFrame:
    """Nearest facility at any distance (NULL columns when there are no facilities)."""
    extra = ["original_type"] if "original_type" in facilities.columns else []
    payload = ["facility_id", "name", "facility_type", *extra]
    best = nearest_points(events, facilities.withColumn("_g", F.lit(0)), payload, ["_g"]).drop("_g", "cell")
    out = events.join(best, [LAT, LON], "left")
    cols = [F.col("best.facility_id").alias("nearest_facility_id"),
            F.col("best.name").alias("nearest_facility_name"),
            F.col("best.facility_type").alias("facility_type"),
            F.col("best.distance_m").alias("distance_to_facility_m")]
    if extra:
        cols.append(F.col("best.original_type").alias("original_facility_type"))
    return out.select(*events.columns, *cols)


def nearest_by_category(events: DataFrame, facilities: DataFrame, categories: dict[str, set[str]]) -> DataFrame:
    """Unbounded nearest distance per category; a facility may belong to several categories."""
    tagged = facilities.withColumn("_g", F.explode(F.array_compact(F.array(*[
        F.when(F.col("facility_type").isin(sorted(types)), F.lit(name)) for name, types in categories.items()]))))
    best = nearest_points(events, tagged, [], ["_g"])
    wide = best.groupBy("cell", LAT, LON).agg(*[
        F.min(F.when(F.col("_g") == name, F.col("best.distance_m"))).alias(f"nearest_{name}_distance_m")
        for name in categories]).drop("cell")
    return events.join(wide, [LAT, LON], "left").select(
        *events.columns, *[f"nearest_{name}_distance_m" for name in categories])


# Fixed category sets of the published enrichment.
INDUSTRIAL_TYPES = {"refinery", "factory", "industrial_area", "chemical", "steel", "cement", "oil_gas"}
POWER_TYPES = {"power_plant"}
OIL_GAS_TYPES = {"oil_gas", "refinery"}
CATEGORIES = {"powerplant": {"power_plant"}, "refinery": {"refinery"}, "oil_gas": {"oil_gas", "refinery"},
              "steel_facility": {"steel"}, "cement_facility": {"cement"}}
INFRASTRUCTURE_TYPES = ["power_plant", "oil_refinery", "oil_well", "ethanol_plant", "wind_farm", "solar_plant"]

FACILITY_COUNTS = [("facility_count_500m", 500.0, None), ("facility_count_1km", 1000.0, None),
                   ("facility_count_5km", 5000.0, None)]
CATEGORY_COUNTS = [("industrial_facility_count_500m", 500.0, INDUSTRIAL_TYPES),
                   ("industrial_facility_count_1km", 1000.0, INDUSTRIAL_TYPES),
                   ("power_facility_count_1km", 1000.0, POWER_TYPES),
                   ("oil_gas_facility_count_1km", 1000.0, OIL_GAS_TYPES)]
INFRASTRUCTURE_COUNTS = [(f"{t}_count_{label}", metres, {t})
                         for label, metres in (("1km", 1000.0), ("5km", 5000.0)) for t in INFRASTRUCTURE_TYPES]


def asset_proximity(events: DataFrame, plants: DataFrame, flares: DataFrame, mines: DataFrame,
                    radius: float) -> DataFrame:
    """Nearest plant, flare and mine of every event in one candidate pass, in the unit of ``radius``.

    Distances are NULL where a table is empty.  Attributes carry the published
    defaults (``Unknown`` for text, 0 for numbers).
    """
    def side(df: DataFrame, kind: str) -> DataFrame:
        attrs = [c for c in df.columns if c not in ("ord", "lat", "lon")]
        return df.select("ord", "lat", "lon", F.lit(kind).alias("_g"), F.to_json(F.struct(*attrs)).alias("_attrs"))

    assets = reduce(DataFrame.unionByName, [side(plants, "plant"), side(flares, "flare"), side(mines, "mine")])
    best = nearest_points(events, assets, ["_attrs"], ["_g"], radius)

    def of(kind: str, field: str) -> Column:
        return F.max(F.when(F.col("_g") == kind, F.col(f"best.{field}")))

    wide = best.groupBy("cell", LAT, LON).agg(
        of("plant", "distance_m").alias("distance_to_plant_km"), of("flare", "distance_m").alias("distance_to_flare_km"),
        of("mine", "distance_m").alias("distance_to_coal_mine_km"),
        of("plant", "_attrs").alias("_plant"), of("flare", "_attrs").alias("_flare"), of("mine", "_attrs").alias("_mine")).drop("cell")
    out = events.join(wide, [LAT, LON], "left")

    def text(blob: str, key: str, name: str) -> Column:
        value = F.get_json_object(blob, f"$.{key}")
        return F.when(F.col(blob).isNotNull(), F.coalesce(value, F.lit("Unknown"))).alias(name)

    def number(blob: str, key: str, name: str) -> Column:
        value = F.get_json_object(blob, f"$.{key}").cast("double")
        return F.when(F.col(blob).isNotNull(), F.coalesce(value, F.lit(0.0))).alias(name)

    d_plant, d_flare, d_mine = (F.col(f"distance_to_{k}_km") for k in ("plant", "flare", "coal_mine"))
    nearest_any = F.least(d_plant, d_flare, d_mine)

    def close(distance: Column, limit: float, name: str) -> Column:
        return F.coalesce((distance <= limit).cast("int"), F.lit(0)).alias(name)

    return out.select(
        *events.columns,
        d_plant.alias("distance_to_plant_km"), F.log1p(d_plant).alias("log_distance_to_plant"),
        F.when(F.col("_plant").isNotNull(), F.get_json_object("_plant", "$.name")).alias("nearest_plant_name"),
        text("_plant", "fuel", "nearest_plant_fuel"), number("_plant", "capacity", "nearest_plant_capacity_mw"),
        text("_plant", "status", "nearest_plant_status"),
        d_flare.alias("distance_to_flare_km"), F.log1p(d_flare).alias("log_distance_to_flare"),
        text("_flare", "field_name", "nearest_flare_field"), text("_flare", "field_operator", "nearest_flare_operator"),
        text("_flare", "flare_level", "nearest_flare_level"),
        number("_flare", "mean_volume", "nearest_flare_mean_vol"),
        number("_flare", "active_years", "nearest_flare_active_years"),
        d_mine.alias("distance_to_coal_mine_km"), F.log1p(d_mine).alias("log_distance_to_coal_mine"),
        text("_mine", "name", "nearest_mine_name"), text("_mine", "mine_type", "nearest_mine_type"),
        text("_mine", "status", "nearest_mine_status"),
        nearest_any.alias("min_distance_to_industrial_km"), F.log1p(nearest_any).alias("log_min_industrial_distance"),
        close(d_plant, 3.0, "is_near_plant_3km"), close(d_flare, 3.0, "is_near_flare_3km"),
        close(d_mine, 5.0, "is_near_mine_5km"), close(nearest_any, 5.0, "is_near_industrial_5km"))
