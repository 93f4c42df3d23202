from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberline.functions import cleaning as K
from emberline.functions.typing_rules import facility_type, is_relevant, landcover_class
from emberline.operators import clean
from emberline.sources import detections

FULL = ("latitude,longitude,bright_ti4,bright_ti5,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,"
        "bright_t31,frp,daynight\n")


def csv(tmp_path, text, name="a.csv"):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def test_scan_trims_blanks_and_drops_empty_rows(spark, tmp_path):
    path = csv(tmp_path, "﻿Lat, LON ,ACQ_DATE,acq_time,sat,conf,frp,ti4\n 10.5 , 70.1 ,2026-01-02,5,N20,n,,330\n,,,,,,,\n11,71,2026-01-02,1342,N20,h,4,331\n")
    rows = detections.read_detections(spark, path).orderBy("_row").collect()
    assert [r["latitude"] for r in rows] == ["10.5", "11"]
    assert rows[0]["frp"] is None and rows[0]["satellite"] == "N20"


def test_semicolon_and_errors(spark, tmp_path):
    path = csv(tmp_path, "latitude;longitude;acq_date\n1;2;2026-01-01\n")
    assert detections.read_detections(spark, path).count() == 1
    with pytest.raises(K.SchemaError):
        detections.read_detections(spark, csv(tmp_path, "latitude,longitude,acq_date\n", "b.csv"))
    with pytest.raises(K.SchemaError):
        detections.read_detections(spark, csv(tmp_path, "longitude,acq_date\n1,2026-01-01\n", "c.csv"))
    with pytest.raises(K.SchemaError):
        detections.read_detections(spark, csv(tmp_path, "", "d.csv"))


def test_chunks_combine_by_name(spark, tmp_path):
    csv(tmp_path, "latitude,longitude,acq_date,frp\n1,2,2026-01-01,3\n", "N20/a.csv")
    csv(tmp_path, "longitude,latitude,acq_date,power\n2,1,2026-01-01,5\n", "N21/b.csv")
    out = detections.read_chunks(spark, str(tmp_path)).orderBy("source").collect()
    assert [(r["source"], r["latitude"], r["frp"]) for r in out] == [("N20", "1", "3"), ("N21", "1", "5")]


ROWS = [  # lat, lon, date, time, frp, ti4, conf -> first failing reason
    ("95", "70", "2026-01-01", "0010", "1", "330", "n", "latitude out of range: 95.0"),
    ("", "70", "2026-01-01", "0010", "1", "330", "n", "missing latitude"),
    ("nan", "70", "2026-01-01", "0010", "1", "330", "n", "NaN latitude"),
    ("10", "abc", "2026-01-01", "0010", "1", "330", "n", "malformed longitude: 'abc'"),
    ("10", "70", "", "0010", "1", "330", "n", "missing acq_date"),
    ("10", "70", "01-01-2026", "0010", "1", "330", "n", "malformed acq_date: '01-01-2026'"),
    ("10", "70", "2026-01-01", "2561", "1", "330", "n", "acq_time out of range: '2561'"),
    ("10", "70", "2026-01-01", "12345", "1", "330", "n", "malformed acq_time: '12345'"),
    ("10", "70", "2026-01-01", "0010", "", "330", "n", "missing frp"),
    ("10", "70", "2026-01-01", "0010", "-2", "330", "n", "negative frp: -2.0"),
    ("10", "70", "2026-01-01", "0010", "1", "", "n", "missing brightness_temperature (no bright_ti4/ti5/t31)"),
    ("10", "70", "2026-01-01", "0010", "1", "1200", "n", "brightness_temperature out of plausible range: 1200.0"),
    ("10", "70", "2026-01-01", "0010", "1", "330", "", "missing confidence"),
    ("10", "70", "2026-01-01", "0010", "1", "330", "101", "confidence out of range 0-100: '101'"),
    ("10", "70", "2026-01-01", "0010", "1", "330", "x", "malformed confidence: 'x'"),
    ("10", "70", "2026/01/01", "9:05:30", "1", "150", "0.5", None),
    ("10", "70", "2026-01-01", "7", "1", "330", "H", None)]


def test_first_failing_reason_wins(spark):
    df = spark.createDataFrame([(i, *r[:7]) for i, r in enumerate(ROWS)], "_row long, lat string, lon string, acq_date string, acq_time string, frp string, ti4 string, conf string")
    got = {r["_row"]: r for r in clean.validated(df).collect()}
    assert [got[i]["reason"] for i in range(len(ROWS))] == [r[7] for r in ROWS]
    assert got[15]["ts"] == datetime(2026, 1, 1, 9, 5, 30) and got[15]["confidence"] == 0.5 and got[15]["bt_out_of_range"]
    assert got[16]["ts"] == datetime(2026, 1, 1, 0, 7) and got[16]["confidence"] == 90.0


def test_iso_timestamp_first(spark):
    df = spark.createDataFrame([("2026-03-01T12:00:00+05:30", None), ("bad", "2026-03-02"), ("2026-03-01 01:02:03", None)], "timestamp string, acq_date string")
    ts, reason = K.acquisition_time(df.columns)
    got = df.select(ts.alias("t"), reason.alias("r")).collect()
    assert [g["t"] for g in got] == [datetime(2026, 3, 1, 6, 30), datetime(2026, 3, 2), datetime(2026, 3, 1, 1, 2, 3)]
    assert all(g["r"] is None for g in got)


def test_dedup_keeps_first_and_real_repeats(spark):
    rows = [(1, "N20", datetime(2026, 1, 1, 0, 5, 10), 10.00001, 70.0), (2, "N20", datetime(2026, 1, 1, 0, 5, 50), 10.00002, 70.0),
            (3, "N20", datetime(2026, 1, 1, 0, 6), 10.0, 70.0), (4, "N21", datetime(2026, 1, 1, 0, 5), 10.0, 70.0), (5, "N20", datetime(2026, 1, 1, 0, 5), 10.001, 70.0)]
    df = spark.createDataFrame(rows, "_row long, satellite string, ts timestamp, latitude double, longitude double")
    assert sorted(r["_row"] for r in clean.dedup(df, ["_row"]).collect()) == [1, 3, 4, 5]


def test_detection_id_is_stable(spark):
    row = spark.range(1).select(K.detection_id(F.lit("N20"), F.lit(datetime(2026, 9, 6, 10, 30)), F.lit(21.7), F.lit(72.5)).alias("i")).first()
    import hashlib
    assert row["i"] == "FIRMS_" + hashlib.sha1(b"N20|2026-09-06T10:30:00Z|21.70000|72.50000").hexdigest()[:8].upper()


@pytest.mark.parametrize("tags,kind", [
    ({"industrial": "refinery"}, "refinery"), ({"industrial": "oil_storage"}, "oil_gas"), ({"power": "plant"}, "power_plant"),
    ({"power": "generator", "generator:source": "wind"}, "other"), ({"power": "generator", "generator:source": "coal"}, "power_plant"),
    ({"landuse": "industrial"}, "industrial_area"), ({"man_made": "storage_tank", "content": "water"}, "other"),
    ({"man_made": "storage_tank", "content": "oil"}, "oil_gas"), ({"man_made": "water_works"}, "factory"), ({"building": "warehouse"}, "warehouse"),
    ({"facility_type": "Steel", "industrial": "oil"}, "steel"), ({"landuse": "light_industrial"}, "industrial_area"), ({"shop": "x"}, "other")])
def test_facility_typing(spark, tags, kind):
    df = spark.createDataFrame([(tags,)], "t map<string,string>")
    assert df.select(facility_type(F.col("t"))["facility_type"].alias("k")).first()["k"] == kind


def test_relevance_drops_generators(spark):
    rows = [({"power": "generator", "industrial": "yes"}, False), ({"power": "substation"}, True), ({"man_made": "petroleum_well"}, True), ({"amenity": "x"}, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t map<string,string>")
    assert [r[0] for r in df.select(is_relevant(F.col("t"))).collect()] == [r[1] for r in rows]


def test_landcover_vocabulary(spark):
    rows = [({"class": "Deciduous Forest"}, "forest"), ({"landuse": "farmland"}, "agriculture"), ({}, "unknown"), ({"class": "tundra"}, "other"),
            ({"class": "tundra", "landuse": "lake"}, "water"), ({"natural": "bare"}, "bare")]
    df = spark.createDataFrame([(r[0],) for r in rows], "p map<string,string>")
    assert [r[0] for r in df.select(landcover_class(F.col("p"))).collect()] == [r[1] for r in rows]
