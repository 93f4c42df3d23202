"""Queries through the file readers and sinks: fixture views are landed as files, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.fixtures import view
from emberline.operators import clean
from emberline.operators.ordered import running_total
from emberline.plans.queries_clean import CHECKED, IDS, ISO, raw_feed
from emberline.plans.registry import query
from emberline.session import checkpoint_dir
from emberline.sources import detections, geojson, sinks

#: Features of one landed document.
DOCUMENT_ROWS = 500


def landing(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def land_documents(rows: DataFrame, path: str, head: str, tail: str) -> None:
    """Rows (ord, item) as JSON documents of at most ``DOCUMENT_ROWS`` items, one document a file, in order of ``ord``."""
    items = rows.withColumn("doc", F.floor(F.col("ord") / DOCUMENT_ROWS))
    text = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]), ",\n"), F.lit(tail))
    items.groupBy("doc").agg(text.alias("value")).write.partitionBy("doc").text(path)


def feature_text(geometry: Column, props: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry")))


def point(lon: str = "lon", lat: str = "lat") -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def rectangle(w: Column, s: Column, e: Column, n: Column) -> Column:
    corners = F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n), F.array(w, s))
    return F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates"))


# ------------------------------------------------------------------ detections

_RAW = ["row_no", "lat", "lon", "acq_date", "acq_time", "frp", "bright_ti4", "bright_ti5", "conf", "sat"]
_CANONICAL = """nullif(trim(lat),'') as latitude, nullif(trim(lon),'') as longitude, acq_date, acq_time, nullif(trim(frp),'') as frp,
  nullif(trim(bright_ti4),'') as bright_ti4, nullif(trim(bright_ti5),'') as bright_ti5, nullif(trim(conf),'') as confidence, sat as satellite"""


@query("scan_csv", f"select cast(row_no as varchar) as row_no, {_CANONICAL} from fx_raw", "fx_raw")
def scan_csv(spark, sf):
    path = landing(spark, "scan-csv")
    view(spark, sf, "fx_raw").select(*_RAW).write.option("header", "true").csv(path)
    return detections.read_detections(spark, path, range_bytes=1 << 18).drop("_file", "_row")


@query("combine_chunks", f"""select case when sat in ('Terra', 'aqua') then 'modis' else 'viirs' end as source, cast(row_no as varchar) as row_no, {_CANONICAL}
from fx_raw""", "fx_raw")
def combine_chunks(spark, sf):
    """Two source folders, each with its own headers, delimiter and column order."""
    path = landing(spark, "chunks")
    raw = view(spark, sf, "fx_raw").select(*_RAW)
    modis = F.col("sat").isin("Terra", "aqua")
    raw.filter(~modis).write.option("header", "true").csv(f"{path}/viirs")
    other = raw.filter(modis).select("sat", F.col("lat").alias("Latitude"), F.col("lon").alias(" LONG"), F.col("conf").alias("confidence"), "row_no", "acq_date",
                                     "acq_time", F.col("frp").alias("fire_radiative_power"), F.col("bright_ti4").alias("TI4"), F.col("bright_ti5").alias("ti5"))
    other.write.option("header", "true").option("sep", ";").csv(f"{path}/modis")
    return detections.read_chunks(spark, path, range_bytes=1 << 18).drop("_file", "_row")


@query("event_list", "select id, latitude, longitude, frp, brightness_temperature, cast(null as double) as confidence from fx_detection where event_id % 3 = 0", "fx_detection")
def event_list(spark, sf):
    """An event list as JSON arrays; what isn't a number becomes NULL."""
    rows = view(spark, sf, "fx_detection").filter("event_id % 3 = 0").select(
        F.col("event_id").alias("ord"), F.to_json(F.struct("id", "latitude", "longitude", F.col("frp").cast("string").alias("frp"), "brightness_temperature",
                                                           F.lit("high").alias("confidence"))).alias("item"))
    path = landing(spark, "event-list")
    land_documents(rows, path, "[", "]")
    return detections.read_events(spark, path).select("id", "latitude", "longitude", "frp", "brightness_temperature", "confidence")


# ------------------------------------------------------------------- documents

@query("facilities_geojson", """select name, facility_type, case when ord%3<2 then facility_id end as given_id,
  round(case when ord%4=0 then lat + 0.004e0 else lat end, 7) as lat, round(case when ord%4=0 then lon + 0.004e0 else lon end, 7) as lon,
  case when ord%4=0 then 'Polygon' else 'Point' end as geom_type, (select count(*) from fx_facility) as ids from fx_facility""", "fx_facility")
def facilities_geojson(spark, sf):
    """Points and polygons of several documents; ids from two properties or generated, all different."""
    k = F.col("ord")
    props = F.struct(F.when(k % 3 == 0, F.col("facility_id")).alias("id"), F.when(k % 3 == 1, F.col("facility_id")).alias("osm_id"), "facility_type",
                     F.when(k % 2 == 0, F.col("name")).alias("name"), F.when(k % 2 == 1, F.col("name")).alias("title"))
    square = rectangle(F.col("lon"), F.col("lat"), F.col("lon") + 0.01, F.col("lat") + 0.01)
    rows = view(spark, sf, "fx_facility").select("ord", F.when(k % 4 == 0, feature_text(square, props)).otherwise(feature_text(point(), props)).alias("item"))
    path = landing(spark, "facilities")
    land_documents(rows, path, '{"type": "FeatureCollection", "features": [', "]}")
    got = geojson.read_geojson_facilities(spark, path)
    ids = got.select(F.count_distinct("facility_id")).first()[0]
    return got.select("name", "facility_type", F.when(~F.col("facility_id").startswith("OSM_"), F.col("facility_id")).alias("given_id"),
                      F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "geom_type", F.lit(ids).cast("long").alias("ids"))


@query("elements_scan", """select concat(case when ord%2=0 then 'node/' else 'way/' end, cast(ord as varchar)) as facility_id, name, facility_type, lat, lon
from fx_facility where ord%7<>0""", "fx_facility")
def elements_scan(spark, sf):
    """Nodes and ways, each twice (the later copy is dropped), some without a position."""
    f, k = view(spark, sf, "fx_facility"), F.col("ord")
    here = k % 7 != 0
    node = F.struct(F.lit("node").alias("type"), F.col("ord").alias("id"), F.when(here, F.col("lat")).alias("lat"), F.when(here, F.col("lon")).alias("lon"),
                    F.struct("name", "facility_type").alias("tags"))
    way = F.struct(F.lit("way").alias("type"), F.col("ord").alias("id"), F.when(here, F.struct("lat", "lon")).alias("center"), F.struct("name", "facility_type").alias("tags"))
    rows = f.select("ord", F.when(k % 2 == 0, F.to_json(node)).otherwise(F.to_json(way)).alias("item"))
    twice = rows.withColumn("item", F.concat("item", F.lit(",\n"), F.regexp_replace("item", '"name":"', '"name":"late ')))
    path = landing(spark, "elements")
    land_documents(twice, path, '{"version": 0.6, "elements": [', "]}")
    return geojson.read_elements(spark, path).select("facility_id", "name", "facility_type", "lat", "lon")


def _areas(spark, sf) -> DataFrame:
    return view(spark, sf, "fx_landcover").select("ord", "class", rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geometry"))


@query("boundary_edges", """with r as (select x0, y0, x1, y1 from fx_landcover where ord = 8)
select x0 as x1, y0 as y1, x1 as x2, y0 as y2 from r union all select x1, y0, x1, y1 from r union all select x1, y1, x0, y1 from r union all select x0, y1, x0, y0 from r""", "fx_landcover")
def boundary_edges(spark, sf):
    """One country's polygon among others in a collection."""
    props = F.struct(F.when(F.col("ord") == 8, "IND").otherwise("XXX").alias("ISO_A3"))
    path = landing(spark, "boundary")
    land_documents(_areas(spark, sf).select("ord", feature_text(F.col("geometry"), props).alias("item")), path, '{"type": "FeatureCollection", "features": [', "]}")
    return geojson.read_boundary(spark, path).select("x1", "y1", "x2", "y2")


@query("landcover_scan", """select class, 4 as edges, x0 as west, y0 as south, x1 as east, y1 as north,
  row_number() over (order by case when class='forest' then 0 else 1 end, ord) as place
from fx_landcover where class in ('forest', 'agriculture')""", "fx_landcover")
def landcover_scan(spark, sf):
    """A forest file and a farmland file, merged in that order; classes come from two properties."""
    areas = _areas(spark, sf)
    paths = []
    for kind, props in (("forest", F.struct(F.lit("Woods").alias("natural"))), ("agriculture", F.struct(F.lit("Farmland").alias("landuse")))):
        paths.append(landing(spark, f"landcover-{kind}"))
        land_documents(areas.filter(F.col("class") == kind).select("ord", feature_text(F.col("geometry"), props).alias("item")), paths[-1],
                       '{"type": "FeatureCollection", "features": [', "]}")
    cover, edges = geojson.read_landcover(spark, *paths)
    boxes = edges.groupBy("geom_id").agg(F.count(F.lit(1)).alias("edges"), F.min("x1").alias("west"), F.min("y1").alias("south"),
                                         F.max("x1").alias("east"), F.max("y1").alias("north"))
    place = running_total(cover.withColumn("one", F.lit(1)), ["ord"], "one", "place")      # among all polygons
    return place.join(boxes, "geom_id").select("class", "edges", "west", "south", "east", "north", "place")


@query("typed_layer_files", """select facility_type, name, case when facility_type='power_plant' then case ord%4 when 0 then 'thermal' when 1 then 'hydro' when 2 then 'other' end end as power_plant_type,
  lat, lon from fx_infra where ord%5<>0""", "fx_infra")
def typed_layer_files(spark, sf):
    """Six layer files of a folder, one feature a line, through the reader; bad positions are dropped."""
    from emberline.operators.layers import LAYER_TYPES
    path, k = landing(spark, "layers"), F.col("ord")
    kind = F.when(k % 4 == 0, "coal_power_plants").when(k % 4 == 1, "small_hydro_power_plants").when(k % 4 == 2, "nuclear").otherwise("")
    props = F.struct(F.col("name").alias("plant_name"), F.col("name").alias("well_name"), F.col("name").alias("utilname"),
                     F.col("name").alias("ppaccompan"), F.col("name").alias("state_name"), kind.alias("layer"))
    rows = view(spark, sf, "fx_infra").withColumn("lat", F.when(k % 5 == 0, F.lit(95.0)).otherwise(F.col("lat")))
    for stem, layer in LAYER_TYPES.items():
        rows.filter(F.col("facility_type") == layer).select(feature_text(point(), props).alias("value")).write.text(f"{path}/{stem}.geojson")
    out = geojson.read_typed_layers(spark, path, lines=True)
    return out.select("facility_type", F.coalesce("plant_name", "well_name", "utilname", "company", "state_name").alias("name"), "power_plant_type", "lat", "lon")


# ----------------------------------------------------------------------- sinks

@query("sink_roundtrip", f"""with {CHECKED}
select id, latitude, longitude, frp, brightness_temperature, confidence, timestamp, satellite, format from (select {IDS} as id, lat_v as latitude, lon_v as longitude, frp_v as frp,
  bt as brightness_temperature, conf_v as confidence, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, satellite from checked where reason is null), (select unnest(['csv', 'parquet']) as format)""", "fx_raw")
def sink_roundtrip(spark, sf):
    """Clean events written as CSV and as date folders of Parquet, and read back."""
    valid, _ = clean.clean_events(raw_feed(spark, sf))
    path = landing(spark, "events")
    sinks.write_events(valid, f"{path}/csv", "csv")
    sinks.write_events(valid, f"{path}/parquet", "parquet", partitioned=True)
    numbers = ("latitude", "longitude", "frp", "brightness_temperature", "confidence")
    back = spark.read.option("header", "true").csv(f"{path}/csv")
    back = back.withColumns({c: F.col(c).cast("double") for c in numbers}).withColumn("format", F.lit("csv"))
    dated = spark.read.parquet(f"{path}/parquet")
    assert dated.filter(F.col("acq_date") != F.to_date("timestamp", ISO)).isEmpty()
    return back.unionByName(dated.drop("acq_date").withColumn("format", F.lit("parquet")))


@query("facility_sink", """select facility_id, name, facility_type, case when ord%4=0 then 'Polygon' when ord%4=1 then 'MultiPolygon' else 'Point' end as geom_type,
  case when ord%4<2 then 4 else 0 end as edges, round(case when ord%4<2 then lat + 0.004e0 else lat end, 7) as lat from fx_facility""", "fx_facility")
def facility_sink(spark, sf):
    """Points, polygons and multi-polygons keep their geometry through the GeoJSON sink."""
    k = F.col("ord")
    square = rectangle(F.col("lon"), F.col("lat"), F.col("lon") + 0.01, F.col("lat") + 0.01)["coordinates"]
    spot = F.array(F.array(F.array(F.array("lon", "lat"))))
    rows = view(spark, sf, "fx_facility").withColumns({
        "geom_type": F.when(k % 4 == 0, "Polygon").when(k % 4 == 1, "MultiPolygon").otherwise("Point"),
        "geom": F.when(k % 4 < 2, F.array(square)).otherwise(spot)})
    path = landing(spark, "facility-sink")
    sinks.write_facilities(rows.drop("ord"), path)
    back = geojson.read_geojson_facilities(spark, path, lines=True)
    areas = back.filter("geom_type <> 'Point'").select(F.col("facility_id").alias("geom_id"), "ord", "geom")
    edges = geojson.edge_table(areas).groupBy(F.col("geom_id").alias("facility_id")).agg(F.count(F.lit(1)).alias("edges"))
    return back.join(edges, "facility_id", "left").select(
        "facility_id", "name", "facility_type", "geom_type", F.coalesce("edges", F.lit(0)).alias("edges"), F.round("lat", 7).alias("lat"))


@query("report_sink", """select satellite, count(*) as n, max(frp) as top from fx_detection group by 1""", "fx_detection")
def report_sink(spark, sf):
    path = landing(spark, "report")
    sinks.write_report(view(spark, sf, "fx_detection").groupBy("satellite").agg(F.count(F.lit(1)).alias("n"), F.max("frp").alias("top")), path)
    return spark.read.json(path).select("satellite", "n", "top")


@query("relational_read", """select 'event' as name, count(*) as n, sum(event_id) as ids from fx_detection union all select 'facility', count(*), sum(ord) from fx_facility
union all select 'prediction', count(*), sum(event_id) from fx_prediction union all select 'alert', count(*), sum(seq) from fx_alert_action""",
       "fx_detection fx_facility fx_prediction fx_alert_action")
def relational_read(spark, sf):
    path = landing(spark, "warehouse")
    sources = {"event": ("fx_detection", "event_id"), "facility": ("fx_facility", "ord"), "prediction": ("fx_prediction", "event_id"), "alert": ("fx_alert_action", "seq")}
    for name, (source, _) in sources.items():
        view(spark, sf, source).write.parquet(f"{path}/{name}")
    got = detections.tables(spark, path)
    parts = [got[name].agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("ids")).select(F.lit(name).alias("name"), "n", "ids") for name, (_, key) in sources.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
