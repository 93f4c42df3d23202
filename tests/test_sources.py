import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberline.functions import sql as sql_functions
from emberline.operators import layers
from emberline.plans import enrich as plans
from emberline.sources import coverage, detections, geojson, sinks


def feature(geometry, **props):
    return {"type": "Feature", "properties": props, "geometry": geometry}


POINT = {"type": "Point", "coordinates": [70.5, 20.5]}
SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
MULTI = {"type": "MultiPolygon", "coordinates": [SQUARE["coordinates"], [[[10, 0], [12, 0], [12, 2], [10, 0]], [[10.5, 0.1], [11, 0.1], [11, 0.3], [10.5, 0.1]]]]}


def put(tmp_path, name, doc):
    p = tmp_path / name
    p.write_text(json.dumps(doc, indent=1) if not isinstance(doc, str) else doc)
    return str(p)


def test_facility_collection(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        feature(POINT, id="A", name="Alpha", industrial="refinery"), feature({"type": "LineString", "coordinates": [[0, 0], [1, 1]]}),
        feature(SQUARE, landuse="industrial"), feature(MULTI, facility_id=7, plant_name="P", power="plant"), feature(None, id="x")]}
    rows = geojson.read_geojson_facilities(spark, put(tmp_path, "f.geojson", doc)).orderBy("ord").collect()
    assert [(r["facility_id"], r["name"], r["facility_type"], r["geom_type"]) for r in rows] == [
        ("A", "Alpha", "refinery", "Point"), ("OSM_2", None, "industrial_area", "Polygon"), ("7", "P", "power_plant", "MultiPolygon")]
    assert (rows[0]["lat"], rows[0]["lon"]) == (20.5, 70.5)
    assert (rows[1]["lat"], rows[1]["lon"]) == pytest.approx((0.8, 0.8))     # closing vertex included


def test_facility_list_feature_and_lines(spark, tmp_path):
    assert geojson.read_geojson_facilities(spark, put(tmp_path, "l.json", [feature(POINT, id="A"), feature(POINT, id="B")])).count() == 2
    assert geojson.read_geojson_facilities(spark, put(tmp_path, "o.json", feature(POINT, id="A"))).first()["facility_id"] == "A"
    text = "\n".join(json.dumps(feature(POINT, id=i)) for i in "ABC")
    assert geojson.read_geojson_facilities(spark, put(tmp_path, "n.json", text), lines=True).count() == 3


def test_elements(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 1, "lat": 10.0, "lon": 70.0, "tags": {"industrial": "oil", "name": "N"}},
                        {"type": "node", "id": 1, "lat": 11.0, "lon": 70.0}, {"type": "way", "id": 1, "center": {"lat": 12.0, "lon": 71.0}, "tags": {"power": "plant"}},
                        {"type": "node", "id": 2}, {"type": "node", "id": 3, "lat": 95.0, "lon": 0.0}]}
    rows = {r["facility_id"]: r for r in geojson.read_elements(spark, put(tmp_path, "e.json", doc)).collect()}
    assert set(rows) == {"node/1", "way/1"}
    assert rows["node/1"]["facility_type"] == "oil_gas" and rows["node/1"]["lat"] == 10.0 and rows["way/1"]["facility_type"] == "power_plant"


def test_boundary_prefers_country_and_validates(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [feature(SQUARE, ISO_A3="XXX"), feature(MULTI, ISO_A3="IND")]}
    edges = geojson.read_boundary(spark, put(tmp_path, "b.json", doc))
    assert edges.select("poly", "ring").distinct().count() == 3 and edges.count() == 4 + 3 + 3
    assert geojson.read_boundary(spark, put(tmp_path, "g.json", SQUARE)).count() == 4
    with pytest.raises(ValueError):
        geojson.read_boundary(spark, put(tmp_path, "p.json", feature(POINT)))
    bad = {"type": "Polygon", "coordinates": [[[0, 0], [200, 0], [2, 2], [0, 0]]]}
    with pytest.raises(ValueError):
        geojson.read_boundary(spark, put(tmp_path, "w.json", bad))


def test_landcover_files_merge_in_order(spark, tmp_path):
    a = put(tmp_path, "a.json", {"type": "FeatureCollection", "features": [feature(SQUARE, landuse="wood"), feature(POINT, landuse="farm")]})
    b = put(tmp_path, "b2.json", {"type": "FeatureCollection", "features": [feature(MULTI, **{"class": "cropland"})]})
    table, edges = geojson.read_landcover(spark, a, b)
    assert [r["class"] for r in table.orderBy("ord").collect()] == ["forest", "agriculture"]
    assert edges.select("geom_id").distinct().count() == 2
    assert geojson.read_landcover(spark, a, b, class_filter="agriculture")[0].count() == 1


def test_six_typed_layers(spark, tmp_path):
    for i, (name, kind) in enumerate(layers.LAYER_TYPES.items()):
        put(tmp_path, f"X_{name}.geojson", {"type": "FeatureCollection", "features": [
            feature(POINT, plant_name="P", layer="hydro_power_plants", distilla_1="5", ppaccompan="C"),
            feature({"type": "Point", "coordinates": [200, 5]}, plant_name="bad")]})
    rows = {r["facility_type"]: r for r in geojson.read_typed_layers(spark, str(tmp_path), prefix="X_").collect()}
    assert set(rows) == set(layers.LAYER_TYPES.values())
    assert rows["power_plant"]["power_plant_type"] == "hydro" and rows["oil_refinery"]["capacity"] == "5" and rows["oil_well"]["company"] is None


def events(spark, n=3):
    rows = [(f"E{i}", 10.0 + i, 70.0, 5.0, 330.0, 60.0, datetime(2026, 1, 1 + i, 3), "N20") for i in range(n)]
    return spark.createDataFrame(rows, "id string, latitude double, longitude double, frp double, brightness_temperature double, confidence double, ts timestamp, satellite string")


def test_event_sink_round_trip_and_empty(spark, tmp_path):
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        sinks.write_events(events(spark), path, fmt)
        back = spark.read.option("header", "true").format(fmt).load(path)
        assert back.count() == 3 and back.columns == ["id", "latitude", "longitude", "frp", "brightness_temperature", "confidence", "timestamp", "satellite"]
    sinks.write_events(events(spark).limit(0), str(tmp_path / "none"))
    assert len(spark.read.parquet(str(tmp_path / "none")).columns) == 8
    sinks.write_events(events(spark), str(tmp_path / "part"), partitioned=True)
    assert spark.read.parquet(str(tmp_path / "part")).filter("acq_date = '2026-01-02'").count() == 1
    with pytest.raises(ValueError):
        sinks.write_events(events(spark), str(tmp_path / "x"), "xlsx")


def test_enriched_facility_and_report_sinks(spark, tmp_path):
    base = events(spark).withColumn("landcover_class", F.lit("forest"))
    sinks.write_enriched(base, str(tmp_path / "en"))
    cols = spark.read.parquet(str(tmp_path / "en")).columns
    assert cols[:8] == events(spark).columns and cols[8:] == plans.ENRICHED
    fac = spark.createDataFrame([(1, "F", 20.0, 70.0, {"a": "b"})], "ord long, facility_id string, lat double, lon double, tags map<string,string>")
    sinks.write_facilities(fac, str(tmp_path / "gj"))
    again = geojson.read_geojson_facilities(spark, str(tmp_path / "gj"), lines=True).first()
    assert (again["facility_id"], again["lat"], again["lon"]) == ("F", 20.0, 70.0)
    sinks.write_facilities(fac, str(tmp_path / "csv"), "csv")
    assert json.loads(spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).first()["tags"]) == {"a": "b"}
    sinks.write_report(spark.createDataFrame([("m", "k", 1.0)], "metric string, key string, value double"), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep")).first()["value"] == 1.0


def test_event_lists(spark, tmp_path):
    path = put(tmp_path, "e.json", [{"id": "a", "latitude": "1.5", "frp": 3, "confidence": "x"}])
    row = detections.read_events(spark, path).first()
    assert row["latitude"] == 1.5 and row["frp"] == 3.0 and row["confidence"] is None
    put(tmp_path, "e.csv", "id,latitude\na,2.5\n")
    assert detections.read_events(spark, str(tmp_path / "e.csv")).first()["latitude"] == 2.5


def test_event_lists_are_inferred_from_texts(spark, tmp_path, monkeypatch):
    """Over thousands of files, inference from multi-line paths takes time by the square of their number."""
    listed, wide = tmp_path / "listed", tmp_path / "wide"
    for i, items in enumerate(([{"id": "a", "frp": 3}], [{"id": "b", "latitude": "1.5"}], {"id": "c", "extra": {"x": 1}})):
        (listed / f"doc={i}").mkdir(parents=True)
        put(listed / f"doc={i}", "e.json", items)
    wide.mkdir()
    (wide / "e.json").write_bytes(json.dumps([{"id": "u", "frp": 4}]).encode("utf-16"))
    paths, kind = [], type(spark.read)
    plain = kind.json
    monkeypatch.setattr(kind, "json", lambda self, path, *a, **k: (paths.append(isinstance(path, str)), plain(self, path, *a, **k))[1])
    out = detections.read_events(spark, str(listed))
    assert paths == [False, True] and set(out.columns) == {"doc", "extra", "frp", "id", "latitude"}
    assert {r["id"]: (r["frp"], r["latitude"]) for r in out.collect()} == {"a": (3.0, None), "b": (None, 1.5), "c": (None, None)}
    assert detections.read_events(spark, str(wide)).first()["id"] == "u"


def test_chunk_calendar_and_coverage(spark):
    spans = spark.createDataFrame([("N20", datetime(2026, 1, 1).date(), datetime(2026, 1, 12).date())], "source string, start date, end date")
    cal = coverage.chunk_calendar(spans, 5)
    rows = cal.orderBy("chunk_start").collect()
    assert [(r["chunk_start"].day, r["chunk_end"].day, r["days"]) for r in rows] == [(1, 5, 5), (6, 10, 5), (11, 12, 2)]
    landed = spark.createDataFrame([("N20", datetime(2026, 1, 1).date(), 9), ("N20", datetime(2026, 1, 6).date(), 0)], "source string, chunk_start date, records long")
    assert [r["status"] for r in coverage.landing_coverage(cal, landed).orderBy("chunk_start").collect()] == ["ok", "empty", "missing"]
    assert coverage.missing_chunks(cal, landed).count() == 1


def test_enrichment_job_keeps_rows_and_order_of_columns(spark):
    ev = events(spark, 4)
    fac = spark.createDataFrame([(1, "F1", "f", "refinery", 10.001, 70.0)], "ord long, facility_id string, name string, facility_type string, lat double, lon double")
    out = plans.enrich(ev, fac)
    assert out.columns == ev.columns + plans.ENRICHED
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == 4 and rows["E0"]["facility_count_500m"] == 1 and rows["E3"]["facility_count_1km"] == 0
    assert rows["E0"]["landcover_class"] == "unknown" and rows["E0"]["distance_to_forest"] is None and rows["E0"]["nearest_steel_facility_distance_m"] is None
    none = plans.enrich(ev, fac.limit(0)).first()
    assert none["nearest_facility_distance_m"] is None and none["facility_count_500m"] == 0


def test_sql_functions_are_inlined(spark):
    assert "haversine_m" in sql_functions.register(spark)
    df = spark.sql("select haversine_m(0, 0, 0, id) as d, persistence_score(4, 19) as p, risk_level(80) as l from range(2)")
    assert [round(r["d"]) for r in df.collect()] == [0, 111195] and df.first()["l"] == "CRITICAL"
    assert "haversine_m" not in df._jdf.queryExecution().executedPlan().toString()


def test_each_file_has_its_own_header_and_delimiter(spark, tmp_path):
    from emberline.sources.detections import read_detections
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("latitude,longitude,frp,acq_date,acq_time,satellite,confidence,bright_ti4\n1,2,3,2024-01-01,101,N20,n,300\n")
    (tmp_path / "a" / "2.csv").write_text("longitude;latitude;frp;acq_date;acq_time;satellite;confidence;bright_ti4\n20;10;3;2024-01-01;101;N20;n;300\n")
    rows = read_detections(spark, str(tmp_path), recursive=True).collect()
    assert sorted((r.latitude, r.longitude) for r in rows) == [("1", "2"), ("10", "20")]


def test_solar_plants_are_no_power_plants(spark, tmp_path):
    import json
    from collections import Counter

    from emberline.operators.layers import LAYER_TYPES
    from emberline.sources.geojson import read_typed_layers
    for i, name in enumerate(LAYER_TYPES):
        doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [i, i]}}]}
        (tmp_path / f"{name}.geojson").write_text(json.dumps(doc))
    (tmp_path / "Old_Oil_Wells.geojson").write_text(json.dumps(doc))          # another layer, not read
    kinds = Counter(r.facility_type for r in read_typed_layers(spark, str(tmp_path)).collect())
    assert kinds == Counter(LAYER_TYPES.values())


def test_rows_without_position_keep_a_null_cluster(spark):
    from emberline.operators.clusters import assign_clusters
    rows = [(1, 10.0, 20.0), (2, 10.0001, 20.0), (3, None, 20.0)]
    got = assign_clusters(spark.createDataFrame(rows, "event_id long, latitude double, longitude double"), 500.0).collect()
    assert sorted((r.event_id, r.cluster_id) for r in got) == [(1, 1), (2, 1), (3, None)]


def test_generated_ids_differ_between_files(spark, tmp_path):
    for name in "ab":
        put(tmp_path, f"{name}.geojson", {"type": "FeatureCollection", "features": [feature(POINT, industrial="oil"), feature(POINT, industrial="steel")]})
    rows = geojson.read_geojson_facilities(spark, str(tmp_path)).collect()
    assert len({r["facility_id"] for r in rows}) == len({r["ord"] for r in rows}) == 4
    lines = "\n".join(json.dumps({"type": "node", "id": i, "lat": 1.0, "lon": 2.0, "tags": {}}) for i in (1, 2, 2))
    assert geojson.read_elements(spark, put(tmp_path, "l.json", lines), lines=True).count() == 2


def test_ranges_of_one_file_give_the_rows_of_the_whole(spark, tmp_path):
    import random
    rng = random.Random(1)
    body = ["\ufefflat , LON,acq_date,frp,power,n;ote\r"]
    for i in range(400):
        body.append(rng.choice([f"{i},2,2024-01-01,{i % 7 or ''},8,\u00e9{'n' * rng.randint(0, 90)}\r", f" {i} , 2 ,2024-01-01,,,", "", "  ", ",,,,,", f"{i},3,2024-01-02", f'{i},4,2024-01-03,"5",6,"a, b",more']))
    path = put(tmp_path, "d.csv", "\n".join(body))
    cols = ["latitude", "frp", "acq_date", "n;ote", "longitude", "_file", "_row"]
    whole = sorted(detections.read_detections(spark, path).select(*[f"`{c}`" for c in cols]).collect())
    assert len(whole) == sum(1 for b in body[1:] if b.strip() and b.strip("\r") != ",,,,,")
    assert {r["frp"] for r in whole} >= {"8", "1", "5", None}        # two sources of one column: the first that is there
    for size in (197, 5000):
        cut = detections.read_detections(spark, path, range_bytes=size)
        assert cut.rdd.getNumPartitions() > 1
        assert sorted(cut.select(*[f"`{c}`" for c in cols]).collect()) == whole
