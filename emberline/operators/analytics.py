"""Exploratory and operational reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.ordered import exact_quantiles
from emberline.operators.proximity import INDUSTRIAL_TYPES, LAT, LON, OIL_GAS_TYPES


def _n(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _long(df: DataFrame, metrics: list[str], key: str = "") -> DataFrame:
    """One wide row -> rows (metric, key, value)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(key).alias("key"), F.col(m).cast("double").alias("value"))
        for m in metrics])).alias("_r")).select("_r.*")


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), 2), F.lit(0.0))


def clip_report(flagged: DataFrame) -> DataFrame:
    """Total, inside, outside and inside percentage of a flagged frame (one row)."""
    inside = F.count_if("inside")
    return flagged.agg(_n("total"), inside.alias("inside"), F.count_if(~F.col("inside")).alias("outside"),
                       _percent(inside, F.count(F.lit(1))).alias("inside_pct"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean, median, sample std and p5/p25/p75/p95/p99 per column (exact quantiles)."""
    names = {0.5: "median", 0.05: "p5", 0.25: "p25", 0.75: "p75", 0.95: "p95", 0.99: "p99"}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_r"))
    base = long.select("_r.*").groupBy("metric").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"))
    q = exact_quantiles(df, columns, list(names)).groupBy("metric").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()])
    return base.join(q, "metric")


def daily_stats(events: DataFrame) -> DataFrame:
    """FRP per day: count, mean, median, max, min, std; 2 decimals, half to even."""
    def two(c) -> Column:
        return F.rint(c * 100) / 100

    dated = events.select(F.to_date("ts").alias("date"), "frp")
    base = dated.groupBy("date").agg(
        _n("count"), two(F.avg("frp")).alias("mean"), two(F.max("frp")).alias("max"), two(F.min("frp")).alias("min"),
        two(F.stddev_samp("frp")).alias("std"))
    median = exact_quantiles(dated, ["frp"], [0.5], ["date"]).select("date", two(F.col("value")).alias("median"))
    return base.join(median, "date")


def time_counts(events: DataFrame) -> DataFrame:
    """Detections by date, hour, month, satellite and day/night from one scan (grouping sets)."""
    from emberline.functions.timefeat import daynight_from_hour
    cols = {"date": F.to_date("ts").cast("string"), "hour": F.hour("ts").cast("string"),
            "month": F.date_format("ts", "yyyy-MM"), "satellite": F.col("satellite"),
            "daynight": daynight_from_hour(F.hour("ts"))}
    base = events.select(*[c.alias(n) for n, c in cols.items()])
    sets = [[F.col(n)] for n in cols]
    grouped = base.groupingSets(sets, *cols).agg(_n("count"), F.grouping_id().alias("_g"))
    # The grouping column of each row is the one that is not aggregated away.
    width = len(cols)
    dim = F
    for i, n in enumerate(cols):
        dim = dim.when(F.col("_g").bitwiseAND(1 << (width - 1 - i)) == 0, F.lit(n))
    return grouped.select(dim.alias("dimension"), F.coalesce(*cols).alias("key"), "count")


def high_activity_days(events: DataFrame) -> DataFrame:
    """Days with more than mean + 2 std detections; the five busiest when there is none."""
    days = events.groupBy(F.to_date("ts").alias("date")).agg(_n("count"))
    limit = days.agg((F.avg("count") + 2 * F.stddev_samp("count")).alias("t")).scalar()
    high = days.filter(F.col("count") > limit)
    busiest = days.orderBy(F.desc("count"), "date").limit(5)
    fallback = busiest.filter(high.agg(F.count(F.lit(1)).alias("n")).scalar() == 0)
    return high.unionByName(fallback)


def density_grid(events: DataFrame, degrees: float = 0.5, k: int = 20) -> DataFrame:
    """The k busiest grid cells."""
    snap = [(F.round(F.floor(F.col(c) / degrees) * degrees, 2)).alias(n) for c, n in ((LAT, "grid_lat"), (LON, "grid_lon"))]
    return (events.groupBy(*snap).agg(_n("count"))
            .orderBy(F.desc("count"), "grid_lat", "grid_lon").limit(k))


def top_frp(events: DataFrame, k: int = 50) -> DataFrame:
    return events.orderBy(F.desc("frp"), "event_id").limit(k)


def flare_sites(years: DataFrame) -> DataFrame:
    """Flare-year rows -> one row per exact site."""
    return years.groupBy("lat", "lon").agg(
        F.min("ord").alias("ord"), F.min_by("country", "ord").alias("country"),
        F.min_by("field_name", "ord").alias("field_name"), F.max_by("flare_level", "ord").alias("flare_level"),
        F.avg("volume").alias("mean_volume"), F.max("volume").alias("max_volume"),
        F.countDistinct("yr").alias("active_years"))


def coverage_tiles(events: DataFrame, degrees: float = 1.0, buffer: float = 0.05) -> DataFrame:
    """Occupied tiles with buffered, clamped bounds and a deterministic id, ordered south to north, west to east."""
    cells = events.groupBy(F.floor(F.col(LAT) / degrees).cast("long").alias("ty"),
                           F.floor(F.col(LON) / degrees).cast("long").alias("tx")).agg(_n("count"))
    out = cells.select(
        "ty", "tx", "count",
        F.greatest(F.lit(-90.0), F.col("ty") * degrees - buffer).alias("south"),
        F.greatest(F.lit(-180.0), F.col("tx") * degrees - buffer).alias("west"),
        F.least(F.lit(90.0), F.col("ty") * degrees + degrees + buffer).alias("north"),
        F.least(F.lit(180.0), F.col("tx") * degrees + degrees + buffer).alias("east"))
    out = out.withColumn("bbox", F.format_string("%.4f,%.4f,%.4f,%.4f", "south", "west", "north", "east"))
    return (out.withColumn("hash", F.substring(F.sha1("bbox"), 1, 8))
            .withColumn("tile_id", F.concat_ws("_", F.lit("tile"), "ty", "tx", "hash"))
            .orderBy("south", "west"))


def tile_stats(tiles: DataFrame) -> DataFrame:
    return tiles.agg(
        _n("num_tiles"), F.sum("count").alias("total_detections"),
        F.round(F.avg("count"), 1).alias("avg_per_tile"), F.max("count").alias("max_per_tile"),
        F.min("count").alias("min_per_tile"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column in long form, from one aggregate row."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("_r")).select("_r.*")


def _value_counts(df: DataFrame, column: str, metric: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enrichment_report(df: DataFrame, temporal: list[str]) -> DataFrame:
    """Coverage of an enriched table in long form (metric, key, value)."""
    dist = F.col("nearest_facility_distance_m")
    covered, known = F.count(dist), F.count_if(F.col("landcover_class") != "unknown")
    total = F.count(F.lit(1))
    base = df.agg(
        total.alias("records"), covered.alias("with_facility"), (total - covered).alias("without_facility"),
        _percent(covered, total).alias("facility_pct"), known.alias("with_landcover"),
        (total - known).alias("without_landcover"), _percent(known, total).alias("landcover_pct"),
        F.min(dist).alias("distance_min"), F.max(dist).alias("distance_max"), F.avg(dist).alias("distance_mean"))
    q = exact_quantiles(df, ["nearest_facility_distance_m"], [0.5, 0.95]).select(
        F.when(F.col("prob") == 0.5, "distance_median").otherwise("distance_p95").alias("metric"),
        F.lit("").alias("key"), "value")
    stats = df.agg(*[f(c).alias(f"{c}|{n}") for c in temporal
                     for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    spread = stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit(n).alias("key"), F.col(f"`{c}|{n}`").cast("double").alias("value"))
        for c in temporal for n in ("min", "max", "mean")])).alias("_r")).select("_r.*")
    return _union([_long(base, base.columns), q, spread,
                   _value_counts(df, "nearest_facility_type", "facility_type"),
                   _value_counts(df, "landcover_class", "landcover")])


def proximity_coverage(df: DataFrame, per_type: list[str]) -> DataFrame:
    """Detections with a facility within 500 m / 1 km / 5 km, distance quantiles and type histogram (long form)."""
    dist, total = F.col("nearest_facility_distance_m"), F.count(F.lit(1))
    cols = [total.alias("total")]
    for label, metres in (("500m", 500), ("1km", 1000), ("5km", 5000)):
        hits = F.count_if(dist <= metres)
        cols += [hits.alias(f"within_{label}"), _percent(hits, total).alias(f"pct_{label}")]
    cols.append((total - F.count_if(dist <= 5000)).alias("no_facility_within_5km"))
    cols += [F.count_if(F.col(c) > 0).alias(c) for c in per_type]
    base = df.agg(*cols)
    q = exact_quantiles(df, ["nearest_facility_distance_m"], [0.5, 0.95]).select(
        F.when(F.col("prob") == 0.5, "median_distance_m").otherwise("p95_distance_m").alias("metric"),
        F.lit("").alias("key"), "value")
    return _union([_long(base, base.columns), q, _value_counts(df, "nearest_facility_type", "nearest_type")])


def count_density(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, max, non-zero rows and their share per count column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("v")) for c in columns]
    )).alias("_r")).select("_r.*")
    hits = F.count_if(F.col("v") > 0)
    return long.groupBy("column").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), hits.alias("non_zero"),
                                      _percent(hits, F.count(F.lit(1))).alias("pct_non_zero"))


def corr_pairs(df: DataFrame, columns: list[str], threshold: float = 0.3) -> DataFrame:
    """Column pairs whose absolute correlation exceeds the threshold: all pairs in one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"c{i}")
                   for i, (a, b) in enumerate(pairs)])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])).alias("_r")).select("_r.*")
    return (long.filter(F.abs("corr") > threshold).withColumn("corr", F.round("corr", 3))
            .orderBy(F.desc(F.abs("corr")), "col_a", "col_b"))


def facility_stats(facilities: DataFrame) -> DataFrame:
    """Inventory by type and by broad category in long form."""
    kind = F.col("facility_type")
    groups = facilities.agg(
        _n("facility_count"), F.countDistinct("facility_id").alias("unique_ids"),
        F.count_if(kind.isin(sorted(INDUSTRIAL_TYPES))).alias("category_industrial"),
        F.count_if(kind == "power_plant").alias("category_power"),
        F.count_if(kind.isin(sorted(OIL_GAS_TYPES))).alias("category_oil_gas"),
        F.count_if(kind == "other").alias("category_other"))
    return _long(groups, groups.columns).unionByName(_value_counts(facilities, "facility_type", "type"))


def kpis(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Total, industrial, critical and persistent sources (one row, real counts)."""
    cls = F.col("classification")
    pred = predictions.agg(
        F.count_if(cls.isin("industrial_fire", "persistent_industrial_thermal_source", "gas_flare")).alias("industrial_events"),
        F.count_if(F.lower("risk_level") == "critical").alias("critical_events"),
        F.count_if(cls == "persistent_industrial_thermal_source").alias("_by_class"))
    seen = events.agg(_n("total_events"), F.count_if(F.col("persistence_score") >= 0.80).alias("_by_score"))
    return pred.select(
        seen.select("total_events").scalar().alias("total_events"), "industrial_events", "critical_events",
        F.greatest(F.col("_by_class"), seen.select("_by_score").scalar()).alias("persistent_sources"))


def map_counts(df: DataFrame, column: str = "detailed_predicted_class") -> DataFrame:
    text = F.col(column)
    return df.agg(_n("total"), F.count_if(text.rlike("(?i)Industrial|Coal|Flare")).alias("industrial_alerts"),
                  F.count_if(text.rlike("(?i)Wildfire|Forest")).alias("wildfires"),
                  F.count_if(text.rlike("(?i)Normal|Background")).alias("normal_background"))


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows and share per weak label, with the unknown and low-confidence shares (long form)."""
    counts = df.groupBy(F.col("weak_label").alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("label").alias("metric"), "key", "value")
    total = F.count(F.lit(1))
    shares = df.agg(_n("total"), _percent(F.count_if(F.col("weak_label") == "unknown"), total).alias("unknown_pct"),
                    F.count_if(F.col("label_confidence") < 0.5).alias("low_confidence"),
                    _percent(F.count_if(F.col("label_confidence") < 0.5), total).alias("low_confidence_pct"))
    return counts.unionByName(_long(shares, shares.columns))


def extent(events: DataFrame) -> DataFrame:
    """Bounds, mean centre and median centre (one row)."""
    q = exact_quantiles(events, [LAT, LON], [0.5])

    def median(c: str) -> Column:
        return q.filter(F.col("metric") == c).select("value").scalar()

    base = events.agg(F.min(LAT).alias("lat_min"), F.max(LAT).alias("lat_max"), F.min(LON).alias("lon_min"),
                      F.max(LON).alias("lon_max"), F.avg(LAT).alias("center_lat"), F.avg(LON).alias("center_lon"))
    return base.select("*", median(LAT).alias("median_lat"), median(LON).alias("median_lon"))


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, stage, count) with real counts of every stage."""
    return _union([df.agg(_n("count")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "count")
                   for i, (name, df) in enumerate(stages, 1)])


def integrity(events: DataFrame) -> DataFrame:
    """Ids, duplicates, NULL ids and invalid coordinates (one row)."""
    return events.agg(
        _n("records"), F.countDistinct("id").alias("unique_ids"),
        (F.count("id") - F.countDistinct("id")).alias("duplicate_ids"), F.count_if(F.col("id").isNull()).alias("null_ids"),
        F.count_if(~F.col(LAT).between(-90, 90)).alias("invalid_lat"),
        F.count_if(~F.col(LON).between(-180, 180)).alias("invalid_lon"))


def heat_cells(events: DataFrame, degrees: float = 0.1, min_frp: float = 3.0) -> DataFrame:
    """FRP-weighted heat layer: summed FRP and detections per cell, for detections of at least ``min_frp``."""
    return (events.filter(F.col("frp") >= min_frp)
            .groupBy(F.floor(F.col(LAT) / degrees).cast("long").alias("cell_y"),
                     F.floor(F.col(LON) / degrees).cast("long").alias("cell_x"))
            .agg(F.sum("frp").alias("frp_sum"), _n("detections")))


def candidate_score(clustered: DataFrame, k: int = 20) -> DataFrame:
    """Top-k candidates by normalised FRP, temperature, active dates and cluster size, plus a night bonus.

    Expects cluster_size_500 and distinct_dates; bounds come from one aggregate row.
    """
    parts = {"frp": 0.4, "brightness_temperature": 0.2, "distinct_dates": 0.2, "cluster_size_500": 0.2}
    bounds = clustered.agg(F.struct(*[f(c).cast("double").alias(f"{n}_{c}") for c in parts
                                      for n, f in (("lo", F.min), ("hi", F.max))]).alias("b"))
    framed = clustered.withColumn("_b", bounds.scalar())

    def norm(c: str) -> Column:
        low, high = F.col(f"_b.lo_{c}"), F.col(f"_b.hi_{c}")
        return (F.col(c) - low) / (high - low + F.lit(1e-9))

    night = F.when(F.hour("ts").between(6, 18), F.lit(0.0)).otherwise(F.lit(0.05))
    score = None
    for c, w in parts.items():
        term = norm(c) * w
        score = term if score is None else score + term
    return (framed.withColumn("candidate_score", score + night).drop("_b")
            .orderBy(F.desc("candidate_score"), "event_id").limit(k))


def activity_7d(events: DataFrame, facilities: DataFrame, key: str = "facility_id") -> DataFrame:
    """Detections per facility for each of the last 7 days of the data; silent days are 0."""
    last = events.agg(F.max(F.to_date("ts")).alias("d")).scalar()
    calendar = facilities.select(key).distinct().withColumn("date", F.explode(F.sequence(F.date_sub(last, 6), last)))
    seen = (events.filter(F.to_date("ts") >= F.date_sub(last, 6)).groupBy(key, F.to_date("ts").alias("date"))
            .agg(_n("detections")))
    return calendar.join(seen, [key, "date"], "left").select(
        key, "date", F.coalesce("detections", F.lit(0)).cast("long").alias("detections"))


def multiplicity_difference(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (by ``columns``) that don't occur equally often in both, with ``before``, ``after``: one aggregate, NULLs equal."""
    return _multiplicities(before, after, columns).filter("before <> after")


def _multiplicities(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    one, none = F.lit(1), F.lit(0)
    signed = before.select(*columns, one.alias("_before"), none.alias("_after")).unionByName(after.select(*columns, none.alias("_before"), one.alias("_after")))
    return signed.groupBy(*columns).agg(F.sum("_before").alias("before"), F.sum("_after").alias("after"))


def multiplicity_by(before: DataFrame, after: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Per value of ``key``, one of the columns: rows of both sides and how many different rows don't occur equally often; one pass over each side."""
    return _multiplicities(before, after, columns).groupBy(key).agg(
        F.sum("before").alias("rows_in"), F.sum("after").alias("rows_out"), F.count_if(F.col("before") != F.col("after")).alias("differing"))
