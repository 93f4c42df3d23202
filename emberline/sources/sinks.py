"""Sinks with fixed layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.clean import EVENT_COLUMNS
from emberline.plans.enrich import ENRICHED

_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def write_events(df: DataFrame, path: str, fmt: str = "parquet", partitioned: bool = False) -> None:
    """Clean events in the fixed 8 columns (ISO time text); the schema is written even when there are no rows.

    ``partitioned`` adds ``acq_date`` folders, so that date filters prune files.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format: {fmt}")
    out = df.withColumn("timestamp", F.date_format("ts", _ISO)).select(
        *EVENT_COLUMNS, *([F.to_date("ts").alias("acq_date")] if partitioned else []))
    writer = out.write.mode("overwrite")
    if partitioned:
        writer = writer.partitionBy("acq_date")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def write_enriched(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Original columns first, then the added ones in fixed order; absent ones are NULL."""
    first = [c for c in df.columns if c not in ENRICHED]
    out = df.select(*first, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ENRICHED])
    writer = out.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def write_facilities(df: DataFrame, path: str, fmt: str = "geojson") -> None:
    """GeoJSON features, one per line, or CSV with the tags as a JSON column.

    With ``geom`` (multi -> polygon -> ring -> vertex) and ``geom_type``, areas keep
    their rings; all other rows are points at (lat, lon).
    """
    if fmt == "geojson":
        props = [c for c in df.columns if c not in ("lat", "lon", "geom", "geom_type")]
        spot = F.to_json(F.array("lon", "lat"))
        kind, body = F.lit("Point"), spot
        if {"geom", "geom_type"} <= set(df.columns):
            area = F.col("geom_type").isin("Polygon", "MultiPolygon") & F.col("geom").isNotNull()
            kind = F.when(area, F.col("geom_type")).otherwise(F.lit("Point"))
            body = F.when(area & (F.col("geom_type") == "Polygon"), F.to_json(F.get("geom", F.lit(0)))).when(area, F.to_json("geom")).otherwise(spot)
        line = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), body,
                        F.lit('},"properties":'), F.to_json(F.struct(*props)), F.lit("}"))
        df.select(line.alias("value")).write.mode("overwrite").text(path)
        return
    flat = df.drop("geom")
    if "tags" in flat.columns:
        flat = flat.withColumn("tags", F.to_json("tags"))
    flat.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").json(path)
