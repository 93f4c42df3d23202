"""Typed infrastructure layers and facility tables: centroid, profile, union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stem of the layer file (after a prefix of the source) -> facility type.
LAYER_TYPES = {"Power_Plants": "power_plant", "Oil_Refineries": "oil_refinery", "Oil_Wells": "oil_well",
               "Ethanol_Plants": "ethanol_plant", "Wind_Farms": "wind_farm", "Solar_Power_Plants": "solar_plant"}
# Power layer -> plant kind.
POWER_KINDS = {"coal_power_plants": "thermal", "natural_gas_power_plants": "thermal", "diesel_power_plants": "thermal",
               "hydro_power_plants": "hydro", "small_hydro_power_plants": "hydro",
               "pumped_storage_hydro_power_plants": "hydro"}
# Attributes kept per type (output name -> source property, first present wins).
LAYER_ATTRIBUTES = {
    "power_plant": {"plant_name": ["plant_name"], "state": ["state"], "district": ["district"], "inst_cap": ["inst_cap"], "layer": ["layer"]},
    "oil_refinery": {"company": ["ppaccompan"], "location": ["location"], "district": ["ppacdistri"], "capacity": ["distillati", "distilla_1"]},
    "oil_well": {"well_name": ["well_name"], "operator": ["operator"]},
    "ethanol_plant": {"utilname": ["utilname"], "statename": ["statename"]},
    "wind_farm": {"plant_name": ["plant_name"], "state": ["state"], "inst_cap": ["inst_cap"], "primary_fu": ["primary_fu"]},
    "solar_plant": {"state_name": ["state_name"], "location": ["location"], "inst_cap_m": ["inst_cap_m"]},
}


def ring_centroid(ring: Column) -> Column:
    """struct(lat, lon): mean of the ring's vertices (closing vertex included); vertices are [lon, lat]."""
    def mean(axis: int) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(axis))) / F.size(ring)

    return F.struct(mean(1).alias("lat"), mean(0).alias("lon"))


def first_exterior(geom: Column) -> Column:
    """First exterior ring of a polygon list (multi -> polygon -> ring -> vertex)."""
    return F.get(F.get(geom, F.lit(0)), F.lit(0))


def power_kind(layer: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in POWER_KINDS.items() for x in pair])
    return F.when(F.nullif(layer, F.lit("")).isNotNull(), F.coalesce(F.try_element_at(table, layer), F.lit("other")))


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def load_facilities(df: DataFrame) -> DataFrame:
    """Facility cache rows -> one typed point per id.

    ``df``: ord, facility_id, name, facility_type (nullable), geom (nested rings,
    points as one vertex), geom_type, tags.  Polygons become the centroid of the
    first exterior ring; a missing or ``other`` type is derived again from the
    tags; the first row of an id survives; bad coordinates are dropped.
    """
    from emberline.functions.typing_rules import facility_type
    from emberline.operators.clean import dedup_facilities
    centre = ring_centroid(first_exterior(F.col("geom")))
    derived = facility_type(F.col("tags"))["facility_type"]
    known = F.nullif(F.nullif("facility_type", F.lit("other")), F.lit(""))
    out = df.filter(F.col("geom_type").isin("Point", "Polygon", "MultiPolygon")).withColumn("_c", centre)
    out = out.select("ord", "facility_id", "name", F.coalesce(known, derived).alias("facility_type"),
                     F.col("_c.lat").alias("lat"), F.col("_c.lon").alias("lon"), "geom_type", "tags")
    return dedup_facilities(out).filter(valid_point(F.col("lat"), F.col("lon")))


def profile_layer(df: DataFrame, layer: str = "layer") -> DataFrame:
    """Per layer: records, missing and invalid coordinates, geometry types and bounding box."""
    lat, lon = F.col("lat"), F.col("lon")
    missing = lat.isNull() | lon.isNull()
    good = valid_point(lat, lon)
    return df.groupBy(layer).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(missing).alias("missing_coordinates"),
        F.count_if(~missing & ~good).alias("invalid_geometries"),
        F.array_join(F.array_sort(F.collect_set("geom_type")), ",").alias("geometry_types"),
        F.min(F.when(good, lon)).alias("west"), F.min(F.when(good, lat)).alias("south"),
        F.max(F.when(good, lon)).alias("east"), F.max(F.when(good, lat)).alias("north"))


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """Layers with different attributes as one table."""
    out = layers[0]
    for df in layers[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
