"""Asset tracker tables (plants, flares, mines) from CSV or Parquet frames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.cleaning import to_double
from emberline.operators.analytics import flare_sites

# Tracker header (whitespace squeezed) -> column.
PLANT_COLUMNS = {"Plant name": "name", "Fuel": "fuel", "Capacity (MW)": "capacity", "Status": "status",
                 "Latitude": "lat", "Longitude": "lon", "Country/Area": "country", "Subregion": "subregion"}
FLARE_COLUMNS = {"Country": "country", "Latitude": "lat", "Longitude": "lon", "Year": "yr", "Field Type": "field_type",
                 "Field Name": "field_name", "Field Operator": "field_operator", "Flare Level": "flare_level",
                 "Flaring Vol (million m3)": "volume"}
MINE_COLUMNS = {"GEM Mine ID": "mine_id", "Country / Area": "country", "Mine Name": "name", "Status": "status",
                "Mine Type": "mine_type", "Latitude": "lat", "Longitude": "lon", "Location Accuracy": "accuracy"}


def _project(df: DataFrame, names: dict[str, str], numbers: list[str], bbox) -> DataFrame:
    """Rename the known columns, keep an ordinal, coerce numbers, drop rows without coordinates, cut to the box.

    ``bbox`` is (south, west, north, east) or None.
    """
    squeezed = df.toDF(*[re.sub(r"\s+", " ", c.strip()) for c in df.columns])
    wanted = {**names, **{v: v for v in names.values()}}
    out = squeezed.select(*(["ord"] if "ord" in squeezed.columns else [F.monotonically_increasing_id().alias("ord")]),
                          *[F.col(f"`{c}`").alias(wanted[c]) for c in squeezed.columns if c in wanted])
    for c in ["lat", "lon", *numbers]:
        out = out.withColumn(c, to_double(F.col(c).cast("string")))
    out = out.dropna(subset=["lat", "lon"])
    if bbox:
        south, west, north, east = bbox
        out = out.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return out


def load_plants(df: DataFrame, bbox=None) -> DataFrame:
    """Plant units; unknown capacity is 0."""
    return _project(df, PLANT_COLUMNS, ["capacity"], bbox).fillna(0.0, ["capacity"])


def load_flares(df: DataFrame, bbox=None) -> DataFrame:
    """Flare-year rows aggregated to one row per site; unknown volume is 0."""
    years = _project(df, FLARE_COLUMNS, ["volume"], bbox).fillna(0.0, ["volume"])
    sites = flare_sites(years)
    if "field_operator" in years.columns:
        operator = years.groupBy("lat", "lon").agg(F.min_by("field_operator", "ord").alias("field_operator"))
        return sites.join(operator, ["lat", "lon"])
    return sites.withColumn("field_operator", F.col("country"))


def load_mines(df: DataFrame, bbox=None) -> DataFrame:
    return _project(df, MINE_COLUMNS, [], bbox)
