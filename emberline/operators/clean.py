"""Raw detections -> clean events, rejects, deduplication and the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.cleaning import (acquisition_time, alias_columns, brightness, confidence_percent,
                                          detection_id, number, require_groups, satellite_name)
from emberline.session import cut

ORDER = ["_file", "_row"]
EVENT_COLUMNS = ["id", "latitude", "longitude", "frp", "brightness_temperature", "confidence", "timestamp", "satellite"]


def _with_order(df: DataFrame) -> DataFrame:
    """File order keys, filled for inputs that have none."""
    if "_file" not in df.columns:
        df = df.withColumn("_file", F.lit(""))
    if "_row" not in df.columns:
        df = df.withColumn("_row", F.monotonically_increasing_id())
    return df


def validated(raw: DataFrame) -> DataFrame:
    """One projection: typed fields plus ``reason`` (first failing check, NULL when valid) and report flags."""
    df = _with_order(require_groups(alias_columns(raw)))
    cols = df.columns

    def field(name: str):
        return F.col(name) if name in cols else F.lit(None).cast("string")

    lat, lat_err = number(field("latitude"), "latitude")
    lon, lon_err = number(field("longitude"), "longitude")
    ts, ts_err = acquisition_time(cols)
    frp, frp_err = number(field("frp"), "frp")
    bt, bt_source = brightness(cols)
    conf, conf_err = confidence_percent(field("confidence"))
    parsed = {"latitude": lat, "longitude": lon, "ts": ts, "frp": frp, "brightness_temperature": bt, "confidence": conf,
              "satellite": satellite_name(cols), "bt_source": bt_source, "_lat": lat_err, "_lon": lon_err, "_ts": ts_err,
              "_frp": frp_err, "_conf": conf_err}
    kept = ["daynight", "scan", "track", "version", "instrument"]
    typed = df.select(
        *ORDER, *[field(c).alias(c) for c in kept],
        F.map_filter(F.create_map(*[x for c in cols if c not in ORDER for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]),
                     lambda _, v: v.isNotNull()).alias("raw"),
        *[c.alias(f"_p_{n}") for n, c in parsed.items()])
    # A one-element generator between parsing and checking: without it the optimizer would push a
    # filter on the reason below the projection and inline every parse into the predicate again.
    typed = typed.select(*ORDER, *kept, "raw", F.inline(F.array(F.struct(*[F.col(f"_p_{n}").alias(n) for n in parsed]))))

    def text(c: str):
        return F.col(c).cast("string")

    b = F.col("brightness_temperature")
    reason = F.coalesce(
        F.col("_lat"),
        F.when(~F.col("latitude").between(-90, 90), F.concat(F.lit("latitude out of range: "), text("latitude"))),
        F.col("_lon"),
        F.when(~F.col("longitude").between(-180, 180), F.concat(F.lit("longitude out of range: "), text("longitude"))),
        F.col("_ts"),
        F.col("_frp"),
        F.when(F.col("frp") < 0, F.concat(F.lit("negative frp: "), text("frp"))),
        F.when(b.isNull(), F.lit("missing brightness_temperature (no bright_ti4/ti5/t31)")),
        F.when(b < 0, F.concat(F.lit("invalid brightness_temperature: "), b.cast("string"))),
        F.when(~b.between(100, 1000),
               F.concat(F.lit("brightness_temperature out of plausible range: "), b.cast("string"))),
        F.col("_conf"))
    out = typed.withColumn("reason", reason)
    flag = (F.when(F.col("reason") == "missing frp", "missing_frp")
            .when(F.col("reason") == "missing confidence", "missing_confidence")
            .when(F.col("reason").startswith("missing brightness_temperature"), "missing_bt"))
    return out.withColumn("missing_flag", flag).withColumn(
        "bt_out_of_range", F.col("reason").isNull() & ~b.between(200, 600)
    ).drop("_lat", "_lon", "_ts", "_frp", "_conf")


def clean_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejects): two filters over one lazy projection, no shuffle."""
    return split_checked(validated(raw))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejects) of what ``validated`` returns."""
    valid = checked.filter("reason is null").drop("reason", "missing_flag", "raw").withColumn(
        "id", detection_id(F.col("satellite"), F.col("ts"), F.col("latitude"), F.col("longitude")))
    valid = valid.withColumn("acq_date", F.to_date("ts"))
    rejects = checked.filter("reason is not null").select(*ORDER, "reason", "missing_flag", "raw")
    return valid, rejects


def _first_of_each(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """First row per key in the given order, by a combining aggregate (no per-key sort, copies merge map-side)."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, F.struct(*order)).alias("_row_"))
    return best.select("_row_.*")


def dedup_keys() -> list:
    return [F.col("satellite"), F.date_trunc("minute", "ts"), F.bround("latitude", 4), F.bround("longitude", 4)]


def dedup(events: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """One row per (satellite, minute, 4-decimal cell); the first in file order survives."""
    return _first_of_each(events, dedup_keys(), order)


def dedup_facilities(df: DataFrame, key: str = "facility_id", order: str = "ord") -> DataFrame:
    """One row per facility id across tiles and layers; the first survives."""
    return _first_of_each(df, [F.col(key)], [order])


def quality_report(raw: DataFrame) -> DataFrame:
    """Counts and ranges of one cleaning run in long form (metric, key, value as text)."""
    checked = validated(raw)
    # Two passes over the input; everything after them reads these two small tables.
    outcome = cut(checked.groupBy(F.trim(F.split("reason", ":")[0]).alias("key"), "missing_flag")
                  .agg(F.count(F.lit(1)).alias("n")))
    kept = cut(dedup(checked.filter("reason is null").drop("raw")).groupBy("satellite").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min("latitude").alias("s"),
        F.max("latitude").alias("n_"), F.min("longitude").alias("w"), F.max("longitude").alias("e")))
    zero = F.lit(0).cast("long")

    def count(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), zero)

    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    unique = kept.agg(F.coalesce(F.sum("n"), zero).alias("n")).scalar()
    bad = F.col("key").isNotNull()
    totals = outcome.agg(
        count(F.lit(True)).alias("input_rows"), count(bad).alias("invalid_rows"),
        *[count(F.col("missing_flag") == f).alias(f) for f in ("missing_frp", "missing_confidence", "missing_bt")],
        count(~bad).alias("_ok")).withColumn("duplicates_removed", F.col("_ok") - unique)
    spans = kept.agg(
        F.coalesce(F.sum("n"), zero).alias("valid_rows"), F.count(F.lit(1)).alias("unique_satellites"),
        F.date_format(F.min("t0"), iso).alias("date_min"), F.date_format(F.max("t1"), iso).alias("date_max"),
        F.min("s").alias("lat_min"), F.max("n_").alias("lat_max"), F.min("w").alias("lon_min"), F.max("e").alias("lon_max"))

    def flat(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.lit("").alias("key"), F.col(m).cast("string").alias("value"))
            for m in df.columns])).alias("r")).select("r.*")

    satellites = kept.select(F.lit("satellite").alias("metric"), F.col("satellite").alias("key"), F.col("n").cast("string").alias("value"))
    reasons = outcome.filter(bad).groupBy("key").agg(F.sum("n").cast("string").alias("value")).select(
        F.lit("invalid_reason").alias("metric"), "key", "value")
    return flat(totals.drop("_ok")).unionByName(flat(spans)).unionByName(satellites).unionByName(reasons)


def bbox_filter(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Rows inside the box; plain range predicates that reach the Parquet scan."""
    return df.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def buffered_extent(events: DataFrame, degrees: float = 2.0) -> DataFrame:
    """One row: the data extent grown by ``degrees`` and clamped to the globe."""
    return events.agg(
        F.greatest(F.lit(-90.0), F.min("latitude") - degrees).alias("south"),
        F.least(F.lit(90.0), F.max("latitude") + degrees).alias("north"),
        F.greatest(F.lit(-180.0), F.min("longitude") - degrees).alias("west"),
        F.least(F.lit(180.0), F.max("longitude") + degrees).alias("east"))


def within_extent(reference: DataFrame, extent: DataFrame) -> DataFrame:
    """Reference rows (lat, lon) inside a one-row extent; scalar subqueries keep this a filter."""
    def bound(name: str):
        return extent.select(name).scalar()

    return reference.filter((F.col("lat") >= bound("south")) & (F.col("lat") <= bound("north"))
                            & (F.col("lon") >= bound("west")) & (F.col("lon") <= bound("east")))
