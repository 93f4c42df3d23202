"""GeoJSON and element scans: facilities, typed layers, boundary, land cover, points of interest.

Files are read with ``spark.read.text(wholetext)`` only when they are pretty
printed documents; a document is exploded into feature rows at once, and line
delimited features (one per line, the layout to use for large sources) are
read in splits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.typing_rules import facility_type, landcover_class
from emberline.operators import layers
from emberline.operators.layers import LAYER_ATTRIBUTES, LAYER_TYPES, first_exterior, ring_centroid

_FEATURE = ("struct<id:string, type:string, geometry:struct<type:string, coordinates:string>, "
            "properties:map<string,string>>")
_DOCUMENT = f"type string, features array<{_FEATURE}>, facilities array<{_FEATURE}>, elements array<string>"
_POLYGON, _MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"
_NO_PROPS = "cast(map() as map<string,string>)"


def features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(_file, ord, id, geom_type, coordinates, props) for every feature.

    Accepts a FeatureCollection, a single Feature, a bare geometry, a list of
    features or an object with a ``facilities`` list; with ``lines`` one feature
    per line.  ``ord`` is the position in the file (list order).
    """
    text = spark.read.text(path, wholetext=not lines).withColumn("_file", F.col("_metadata.file_path"))
    one = F.from_json("value", _FEATURE)
    if lines:
        rows = text.filter(F.trim("value") != "").select("_file", F.monotonically_increasing_id().alias("ord"), one.alias("f"))
    else:
        doc = F.from_json("value", _DOCUMENT)
        head = F.substring(F.ltrim(F.regexp_replace("value", "^﻿", "")), 1, 1)
        many = F.when(head == "[", F.from_json("value", f"array<{_FEATURE}>")).otherwise(
            F.coalesce(doc["features"], doc["facilities"]))
        bare = F.from_json("value", "struct<type:string, coordinates:string>")
        single = F.when(bare["type"] == "Feature", F.array(one)).when(
            bare["coordinates"].isNotNull(),
            F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("Feature").alias("type"), bare.alias("geometry"),
                             F.expr(_NO_PROPS).alias("properties"))))
        rows = text.select("_file", F.posexplode(F.coalesce(many, single)).alias("ord", "f"))
        rows = _in_file_order(text, rows)
    return rows.select("_file", F.col("ord").cast("long").alias("ord"), F.col("f.id").alias("id"),
                       F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"),
                       F.coalesce("f.properties", F.expr(_NO_PROPS)).alias("props"))


def _in_file_order(text: DataFrame, rows: DataFrame) -> DataFrame:
    """Let ``ord`` go on from file to file (by path), so that it names one row of all files."""
    plain = re.compile("^([a-z0-9]+):/+")                # the two listings write roots differently
    files = sorted(plain.sub(r"\1:/", f) for f in text.inputFiles())
    if len(files) < 2:
        return rows
    ranks = text.sparkSession.createDataFrame([(f, i << 33) for i, f in enumerate(files)], "_name string, _first long")
    named = rows.withColumn("_name", F.regexp_replace("_file", plain.pattern, "$1:/"))
    return named.join(ranks, "_name").withColumn("ord", F.col("_first") + F.col("ord")).drop("_first", "_name")


def _rings() -> Column:
    """Coordinates text -> multi -> polygon -> ring -> vertex (a point is one vertex)."""
    point = F.from_json("coordinates", "array<double>")
    return (F.when(F.col("geom_type") == "Point", F.array(F.array(F.array(point))))
            .when(F.col("geom_type") == "Polygon", F.array(F.from_json("coordinates", _POLYGON)))
            .when(F.col("geom_type") == "MultiPolygon", F.from_json("coordinates", _MULTI)))


def edge_table(df: DataFrame) -> DataFrame:
    """Polygon rows (geom_id, ord, geom) -> edges (geom_id, ord, poly, ring, x1, y1, x2, y2); rings close themselves."""
    flat = (df.select("geom_id", "ord", F.posexplode("geom").alias("poly", "_p"))
            .select("geom_id", "ord", "poly", F.posexplode("_p").alias("ring", "_r")))
    nxt = F.concat(F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0))), F.slice("_r", 1, 1))
    sides = flat.select("geom_id", "ord", "poly", "ring", F.explode(F.arrays_zip(F.col("_r").alias("a"), nxt.alias("b"))).alias("e"))
    return sides.select("geom_id", "ord", "poly", "ring", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"),
                        F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2")).filter("x1 <> x2 or y1 <> y2")


def read_geojson_facilities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Facilities with id, name, canonical type, point coordinates (centroid for polygons) and geometry."""
    raw = features(spark, path, lines).filter(F.col("geom_type").isin("Point", "Polygon", "MultiPolygon"))

    def prop(*keys: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at("props", F.lit(k)), F.lit("")) for k in keys])

    kind = facility_type(F.col("props"))
    out = raw.withColumns({"geom": _rings(), "_t": kind})
    out = out.withColumn("_c", ring_centroid(first_exterior(F.col("geom"))))
    return out.select(
        "ord", F.coalesce(prop("id", "facility_id", "fid", "osm_id"), F.concat(F.lit("OSM_"), F.col("ord").cast("string"))).alias("facility_id"),
        prop("name", "facility_name", "plant_name", "title").alias("name"), F.col("_t.facility_type").alias("facility_type"),
        F.col("_t.original_type").alias("original_type"), F.col("_file").alias("source"), F.col("_c.lat").alias("lat"),
        F.col("_c.lon").alias("lon"), "geom_type", "geom", F.col("props").alias("tags"))


def read_elements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Point-of-interest elements (nodes by position, ways by centre) as typed facilities, one per type/id; with ``lines`` one a line."""
    doc = F.from_json("value", _DOCUMENT)
    element = ("struct<type:string, id:string, lat:double, lon:double, center:struct<lat:double, lon:double>, "
               "tags:map<string,string>>")
    text = spark.read.text(path, wholetext=not lines).withColumn("_file", F.col("_metadata.file_path"))
    if lines:
        rows = text.filter(F.trim("value") != "").select("_file", F.monotonically_increasing_id().alias("ord"), F.col("value").alias("_e"))
    else:
        rows = _in_file_order(text, text.select("_file", F.posexplode(doc["elements"]).alias("ord", "_e")))
    rows = rows.select("_file", "ord", F.from_json("_e", element).alias("e"))
    tags = F.coalesce("e.tags", F.expr(_NO_PROPS))
    out = rows.select(F.col("ord").cast("long").alias("ord"), F.concat_ws("/", "e.type", "e.id").alias("facility_id"),
                      F.try_element_at(tags, F.lit("name")).alias("name"),
                      facility_type(tags).alias("_t"), F.coalesce("e.lat", "e.center.lat").alias("lat"),
                      F.coalesce("e.lon", "e.center.lon").alias("lon"), tags.alias("tags"))
    out = out.filter(layers.valid_point(F.col("lat"), F.col("lon")))
    from emberline.operators.clean import dedup_facilities
    return dedup_facilities(out.select("ord", "facility_id", "name", "_t.facility_type", "_t.original_type", "lat", "lon", "tags"))


def typed_layer(df: DataFrame, kind: str) -> DataFrame:
    """Rows of one layer (ord, geom_type, lat, lon, props) with its attributes; bad coordinates are dropped."""
    def prop(names: list[str]) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at("props", F.lit(n)), F.lit("")) for n in names])

    cols = [prop(names).alias(out) for out, names in LAYER_ATTRIBUTES[kind].items()]
    if kind == "power_plant":
        cols.append(layers.power_kind(F.try_element_at("props", F.lit("layer"))).alias("power_plant_type"))
    return df.filter(layers.valid_point(F.col("lat"), F.col("lon"))).select(
        "ord", F.lit(kind).alias("facility_type"), "lat", "lon", F.lit("Point").alias("geom_type"), *cols, "props")


def read_layer(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Raw rows of one layer file: ord, geom_type, lat, lon (centroid for polygons), props."""
    raw = features(spark, path, lines).withColumn("_c", ring_centroid(first_exterior(_rings())))
    return raw.select("_file", "ord", "geom_type", F.col("_c.lat").alias("lat"), F.col("_c.lon").alias("lon"), "props")


def read_typed_layers(spark: SparkSession, directory: str, lines: bool = False, prefix: str = "") -> DataFrame:
    """The six infrastructure layers of a directory as one table; the whole file name, less ``prefix``, decides the type."""
    return layers.union_layers([typed_layer(read_layer(spark, f"{directory}/{prefix}{stem}.geojson", lines), kind) for stem, kind in LAYER_TYPES.items()])


def read_boundary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Edge table of a country boundary; the feature marked IND (or India) is preferred, else the first.

    Raises when there is no polygon or a coordinate is outside WGS84 ranges.
    """
    raw = features(spark, path, lines)
    preferred = (F.try_element_at("props", F.lit("ISO_A3")) == "IND") | (F.try_element_at("props", F.lit("ADMIN")) == "India")
    chosen = raw.orderBy(F.coalesce(preferred, F.lit(False)).desc(), "ord").limit(1)
    polygon = chosen.filter(F.col("geom_type").isin("Polygon", "MultiPolygon")).select(
        F.lit("boundary").alias("geom_id"), F.lit(0).cast("long").alias("ord"), _rings().alias("geom"))
    edges = edge_table(polygon)
    check = edges.agg(F.count(F.lit(1)).alias("n"), F.count_if(~(
        F.coalesce(F.col("x1").between(-180, 180) & F.col("y1").between(-90, 90), F.lit(False)))).alias("bad")).first()
    if check["n"] == 0:
        raise ValueError("the boundary must be a Polygon or MultiPolygon")
    if check["bad"]:
        raise ValueError(f"{check['bad']} boundary coordinates are outside WGS84 ranges")
    return edges


def read_landcover(spark: SparkSession, *paths: str, class_filter: str | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(land-cover table, edge table); several files merge in the given order."""
    parts = []
    for i, path in enumerate(paths):
        raw = features(spark, path, lines).filter(F.col("geom_type").isin("Polygon", "MultiPolygon"))
        parts.append(raw.select((F.col("ord") + F.lit(i << 56)).alias("ord"), _rings().alias("geom"),
                                landcover_class(F.col("props")).alias("class")))
    rows = layers.union_layers(parts).withColumn("geom_id", F.col("ord").cast("string"))
    if class_filter:
        rows = rows.filter(F.col("class") == class_filter)
    return rows.select("ord", "geom_id", "class"), edge_table(rows)
