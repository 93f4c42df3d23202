"""Queries over exploratory and operational reports."""

from pyspark.sql import functions as F

from emberline.fixtures import view
from emberline.operators import analytics, clean, evaluate, layers, polygons, proximity, split
from emberline.plans.queries_alerts import served
from emberline.plans.queries_clean import CHECKED, FIRST, raw_feed
from emberline.plans.queries_spatial import (COUNTS, INSIDE_RECT, PAIRS, TYPES, det, fac, infra, landcover,
                                             landcover_edges, near_cte)
from emberline.plans.registry import query
from emberline.sources import coverage


def rounded(df, columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def profile_sql(col: str) -> str:
    q = ", ".join(f"round(quantile_cont({col}, {p}), 6) as {n}" for p, n in ((0.5, "median"), (0.05, "p5"), (0.25, "p25"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99")))
    return f"select '{col}' as metric, min({col}) as min, max({col}) as max, round(avg({col}), 6) as mean, round(stddev_samp({col}), 6) as std, {q} from fx_detection"


@query("numeric_profile", " union all ".join(profile_sql(c) for c in ("frp", "brightness_temperature", "confidence")), "fx_detection")
def numeric_profile(spark, sf):
    out = analytics.numeric_profile(det(spark, sf), ["frp", "brightness_temperature", "confidence"])
    return rounded(out, ["mean", "std", "median", "p5", "p25", "p75", "p95", "p99"])


@query("daily_stats", """select strftime(ts, '%Y-%m-%d') as date, count(*) as count, round_even(avg(frp), 2) as mean, round_even(median(frp), 2) as median, max(frp) as max, min(frp) as min, round_even(stddev_samp(frp), 2) as std
 from fx_detection group by 1""", "fx_detection")
def daily_stats(spark, sf):
    return analytics.daily_stats(det(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("time_counts", """with b as (select strftime(ts, '%Y-%m-%d') as d, cast(hour(ts) as varchar) as h, strftime(ts, '%Y-%m') as m, satellite as s, case when hour(ts) between 6 and 18 then 'D' else 'N' end as dn from fx_detection)
select 'date' as dimension, d as key, count(*) as count from b group by d union all select 'hour', h, count(*) from b group by h union all select 'month', m, count(*) from b group by m
union all select 'satellite', s, count(*) from b group by s union all select 'daynight', dn, count(*) from b group by dn""", "fx_detection")
def time_counts(spark, sf):
    return analytics.time_counts(det(spark, sf))


@query("high_activity_days", """with d as (select cast(ts as date) as date, count(*) as n from fx_detection group by 1), h as (select * from d where n > (select avg(n)+2*stddev_samp(n) from d))
select strftime(date, '%Y-%m-%d') as date, n as count from h union all select * from (select strftime(date, '%Y-%m-%d'), n from d where not exists (select 1 from h) order by n desc, date limit 5)""", "fx_detection")
def high_activity_days(spark, sf):
    return analytics.high_activity_days(det(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("density_grid", """select round(floor(latitude/0.5e0)*0.5e0, 2) as grid_lat, round(floor(longitude/0.5e0)*0.5e0, 2) as grid_lon, count(*) as count from fx_detection group by 1, 2 order by 3 desc, 1, 2 limit 20""", "fx_detection")
def density_grid(spark, sf):
    return analytics.density_grid(det(spark, sf))


@query("top_frp", "select event_id, frp, brightness_temperature, satellite from fx_detection order by frp desc, event_id limit 50", "fx_detection")
def top_frp(spark, sf):
    return analytics.top_frp(det(spark, sf)).select("event_id", "frp", "brightness_temperature", "satellite")


TILES = """tiles as (select cast(floor(latitude) as bigint) as ty, cast(floor(longitude) as bigint) as tx, count(*) as count from fx_detection group by 1, 2),
 boxes as (select *, greatest(-90e0, ty-0.05e0) as s, greatest(-180e0, tx-0.05e0) as w, least(90e0, ty+1e0+0.05e0) as n, least(180e0, tx+1e0+0.05e0) as e from tiles)"""


@query("coverage_tiles", f"""with {TILES} select concat('tile_', cast(ty as string), '_', cast(tx as string), '_', substr(sha1(printf('%.4f,%.4f,%.4f,%.4f', s, w, n, e)), 1, 8)) as tile_id, count, round(s, 4) as south, round(w, 4) as west, round(n, 4) as north, round(e, 4) as east from boxes""", "fx_detection")
def coverage_tiles(spark, sf):
    return rounded(analytics.coverage_tiles(det(spark, sf)).select("tile_id", "count", "south", "west", "north", "east"), ["south", "west", "north", "east"], 4)


@query("tile_stats", f"with {TILES} select count(*) as num_tiles, cast(sum(count) as bigint) as total_detections, round(avg(count), 1) as avg_per_tile, max(count) as max_per_tile, min(count) as min_per_tile from tiles", "fx_detection")
def tile_stats(spark, sf):
    return analytics.tile_stats(analytics.coverage_tiles(det(spark, sf)))


MISSING = ["distance_to_facility_m", "distance_to_forest_m", "distance_to_agriculture_m", "facility_type", "persistence_score", "ndvi", "ndbi", "facility_baseline", "current_activity", "frp"]


@query("missingness", " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as missing from fx_context" for c in MISSING), "fx_context")
def missingness(spark, sf):
    return analytics.missingness(view(spark, sf, "fx_context"), MISSING)


def long_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    return " union all ".join(f"select '{m}' as metric, '' as key, cast({e} as double) as value from {source}" for m, e in pairs)


@query("enrichment_report", f"""with {near_cte('fx_infra')}, {INSIDE_RECT}, {PAIRS}, {COUNTS},
 best as (select event_id, arg_min(facility_type, (d, ord)) as t, min(d) as d from near where d <= 5000 group by 1), lc as (select event_id, arg_min(class, ord) as c from hits join fx_landcover using (ord) group by 1),
 en as (select e.event_id, b.t, round(b.d, 6) as d, coalesce(c, 'unknown') as c, d24, d7 from fx_detection e left join best b using (event_id) left join lc using (event_id) join counts using (event_id))
{long_sql('en', [('records', 'count(*)'), ('with_facility', 'count(d)'), ('without_facility', 'count(*)-count(d)'), ('facility_pct', 'round(100e0*count(d)/count(*),2)'), ('with_landcover', "count(*) filter (c<>'unknown')"), ('without_landcover', "count(*) filter (c='unknown')"), ('landcover_pct', "round(100e0*count(*) filter (c<>'unknown')/count(*),2)"), ('distance_min', 'round(min(d),3)'), ('distance_max', 'round(max(d),3)'), ('distance_mean', 'round(avg(d),3)'), ('distance_median', 'round(quantile_cont(d,0.5),3)'), ('distance_p95', 'round(quantile_cont(d,0.95),3)')])}
 union all {" union all ".join(f"select '{n}', '{k}', cast({f} as double) from en" for n, c in (("detections_24h", "d24"), ("detections_7d", "d7")) for k, f in (("min", f"min({c})"), ("max", f"max({c})"), ("mean", f"round(avg({c}),3)")))}
 union all select 'facility_type', t, count(*) from en where t is not null group by t union all select 'landcover', c, count(*) from en group by c""", "fx_detection fx_infra fx_landcover fx_landcover_edge")
def enrichment_report(spark, sf):
    from emberline.operators import enrichment
    out = proximity.nearest_within(enrichment.persistence(det(spark, sf)), infra(spark, sf))
    out = polygons.landcover_of(out, landcover(spark, sf), landcover_edges(spark, sf))
    return rounded(analytics.enrichment_report(out, ["detections_24h", "detections_7d"]), ["value"], 3)


@query("proximity_coverage", f"""with {near_cte('fx_infra')}, en as (select e.event_id, (select min(d) from near n where n.event_id=e.event_id and d<=5000) as d, (select arg_min(facility_type, (d, ord)) from near n where n.event_id=e.event_id and d<=5000) as t,
 {', '.join(f"(select count(*) from near n where n.event_id=e.event_id and d<=1000 and facility_type='{t}') as {t}" for t in TYPES)} from fx_detection e)
{long_sql('en', [('total', 'count(*)')] + [x for l, m in (('500m', 500), ('1km', 1000), ('5km', 5000)) for x in ((f'within_{l}', f'count(*) filter (d<={m})'), (f'pct_{l}', f'round(100e0*count(*) filter (d<={m})/count(*),2)'))] + [('no_facility_within_5km', 'count(*)-count(d)'), ('median_distance_m', 'round(quantile_cont(d,0.5),3)'), ('p95_distance_m', 'round(quantile_cont(d,0.95),3)')] + [(f'{t}_count_1km', f'count(*) filter ({t}>0)') for t in TYPES])}
 union all select 'nearest_type', t, count(*) from en where t is not null group by t""", "fx_detection fx_infra")
def proximity_coverage(spark, sf):
    per_type = [f"{t}_count_1km" for t in TYPES]
    out = proximity.radius_counts(proximity.nearest_within(det(spark, sf), infra(spark, sf)), infra(spark, sf), proximity.INFRASTRUCTURE_COUNTS)
    return rounded(analytics.proximity_coverage(out, per_type), ["value"], 3)


@query("count_density", f"""with {near_cte('fx_facility')}, en as (select e.event_id, count(*) filter (d<=500) as facility_count_500m, count(*) filter (d<=1000) as facility_count_1km, count(*) filter (d<=5000) as facility_count_5km from fx_detection e left join near using (event_id) group by 1)
{' union all '.join(f"""select '{c}' as "column", round(avg({c}), 6) as mean, max({c}) as max, count(*) filter ({c}>0) as non_zero, round(100e0*count(*) filter ({c}>0)/count(*), 2) as pct_non_zero from en""" for c in ('facility_count_500m', 'facility_count_1km', 'facility_count_5km'))}""", "fx_detection fx_facility")
def count_density(spark, sf):
    names = [n for n, _, _ in proximity.FACILITY_COUNTS]
    out = proximity.radius_counts(det(spark, sf), fac(spark, sf), proximity.FACILITY_COUNTS)
    return rounded(analytics.count_density(out, names), ["mean"])


CORR = ["frp", "brightness_temperature", "confidence", "persistence_score", "detections_24h", "detections_7d", "detections_30d", "hotspot_cluster_size", "ndvi", "facility_baseline"]
_PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1:]]


@query("corr_pairs", "select col_a, col_b, round(corr, 3) as corr from (" + " union all ".join(f"select '{a}' as col_a, '{b}' as col_b, corr({a}, {b}) as corr from fx_context" for a, b in _PAIRS) + ") where abs(corr) > 0.3e0", "fx_context")
def corr_pairs(spark, sf):
    return analytics.corr_pairs(view(spark, sf, "fx_context"), CORR)


@query("facility_stats", f"""{long_sql('fx_facility', [('facility_count', 'count(*)'), ('unique_ids', 'count(distinct facility_id)'), ('category_industrial', "count(*) filter (facility_type in ('refinery','factory','industrial_area','chemical','steel','cement','oil_gas'))"), ('category_power', "count(*) filter (facility_type='power_plant')"), ('category_oil_gas', "count(*) filter (facility_type in ('oil_gas','refinery'))"), ('category_other', "count(*) filter (facility_type='other')")])}
 union all select 'type', facility_type, count(*) from fx_facility group by facility_type""", "fx_facility")
def facility_stats(spark, sf):
    return analytics.facility_stats(fac(spark, sf))


@query("kpis", """select (select count(*) from fx_event_facility) as total_events, count(*) filter (classification in ('industrial_fire','persistent_industrial_thermal_source','gas_flare')) as industrial_events,
 count(*) filter (risk_level='CRITICAL') as critical_events, greatest(count(*) filter (classification='persistent_industrial_thermal_source'), (select count(*) from fx_event_facility where persistence_score>=0.8e0)) as persistent_sources from fx_prediction""", "fx_event_facility fx_prediction")
def kpis(spark, sf):
    events, predictions, _ = served(spark, sf)
    return analytics.kpis(events, predictions)


@query("extent", """select min(latitude) as lat_min, max(latitude) as lat_max, min(longitude) as lon_min, max(longitude) as lon_max, round(avg(latitude), 6) as center_lat, round(avg(longitude), 6) as center_lon,
 round(median(latitude), 6) as median_lat, round(median(longitude), 6) as median_lon from fx_detection""", "fx_detection")
def extent(spark, sf):
    return rounded(analytics.extent(det(spark, sf)), ["center_lat", "center_lon", "median_lat", "median_lon"])


@query("funnel", f"""with {CHECKED}, uniq as (select * from checked where reason is null qualify {FIRST})
select 1 as step, 'fetched' as stage, count(*) as count from fx_raw union all select 2, 'valid', count(*) from checked where reason is null union all select 3, 'unique', count(*) from uniq
union all select 4, 'enriched', count(*) from fx_detection union all select 5, 'analysed', count(*) from fx_prediction union all select 6, 'priority', count(*) from fx_prediction where risk_score>=50
union all select 7, 'alert', count(*) from fx_prediction where risk_score>=75""", "fx_raw fx_prediction")
def funnel(spark, sf):
    raw = raw_feed(spark, sf)
    valid, _ = clean.clean_events(raw)
    pred = view(spark, sf, "fx_prediction")
    return analytics.funnel([("fetched", raw), ("valid", valid), ("unique", clean.dedup(valid)), ("enriched", det(spark, sf)),
                             ("analysed", pred), ("priority", pred.filter("risk_score >= 50")), ("alert", pred.filter("risk_score >= 75"))])


@query("integrity", """select count(*) as records, count(distinct id) as unique_ids, count(id)-count(distinct id) as duplicate_ids, count(*)-count(id) as null_ids, count(*) filter (latitude not between -90 and 90) as invalid_lat,
 count(*) filter (longitude not between -180 and 180) as invalid_lon from fx_detection""", "fx_detection")
def integrity(spark, sf):
    return analytics.integrity(det(spark, sf))


@query("heat_cells", "select cast(floor(latitude/0.1e0) as bigint) as cell_y, cast(floor(longitude/0.1e0) as bigint) as cell_x, round(sum(frp), 4) as frp_sum, count(*) as detections from fx_detection where frp>=3 group by 1, 2", "fx_detection")
def heat_cells(spark, sf):
    return rounded(analytics.heat_cells(det(spark, sf)), ["frp_sum"], 4)


@query("activity_7d", """with last as (select max(cast(ts as date)) as d from fx_event_facility), cal as (select facility_id, cast(unnest(generate_series(d - interval 6 day, d, interval 1 day)) as date) as day from fx_facility, last),
 seen as (select facility_id, cast(ts as date) as day, count(*) as n from fx_event_facility group by 1, 2)
select facility_id, strftime(day, '%Y-%m-%d') as date, coalesce(n, 0) as detections from cal left join seen using (facility_id, day)""", "fx_event_facility fx_facility")
def activity_7d(spark, sf):
    events, _, facilities = served(spark, sf)
    return analytics.activity_7d(events, facilities).withColumn("date", F.col("date").cast("string"))


LABELS = ["agricultural_fire", "gas_flare", "industrial_fire", "persistent_industrial_thermal_source", "wildfire", "unknown"]
LIST = "(select unnest([" + ",".join(f"'{x}'" for x in LABELS) + "]) as label)"
METRICS = f"""conf as (select t.label as true_label, c.label as classification, count(p.event_id) as n from {LIST} t cross join {LIST} c left join fx_prediction p on p.true_label=t.label and p.classification=c.label group by 1, 2),
pc as (select l.label, sum(n) filter (true_label=l.label) as sup, sum(n) filter (classification=l.label) as prd, sum(n) filter (true_label=l.label and classification=l.label) as tp from conf, {LIST} l group by 1),
cm as (select label, cast(sup as bigint) as support, case when prd=0 then 0 else tp/prd end as precision, case when sup=0 then 0 else tp/sup end as recall, tp, prd from pc),
fm as (select *, case when precision+recall=0 then 0 else 2*precision*recall/(precision+recall) end as f1 from cm)"""


@query("confusion", f"with {METRICS} select * from conf", "fx_prediction")
def confusion(spark, sf):
    return evaluate.confusion(view(spark, sf, "fx_prediction"))


@query("class_metrics", f"with {METRICS} select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from fm", "fx_prediction")
def class_metrics(spark, sf):
    out = evaluate.class_metrics(evaluate.confusion(view(spark, sf, "fx_prediction"))).drop("tp", "predicted")
    return rounded(out, ["precision", "recall", "f1"])


@query("overall_metrics", f"""with {METRICS} select round(sum(tp)/sum(support), 6) as accuracy, round(avg(precision), 6) as macro_precision, round(avg(recall), 6) as macro_recall, round(avg(f1), 6) as macro_f1,
 round(sum(f1*support)/sum(support), 6) as weighted_f1 from fm""", "fx_prediction")
def overall_metrics(spark, sf):
    out = evaluate.evaluate(view(spark, sf, "fx_prediction"))
    return rounded(out, out.columns)


@query("metric_delta", f"""with {METRICS}, always as (select label, case when label='unknown' then 2*(sup/tot)/(1+sup/tot) else 0 end as f1 from (select label, sup, sum(sup) over () as tot from pc))
select fm.label, round(fm.f1, 6) as base_f1, round(always.f1, 6) as other_f1, support, round(always.f1-fm.f1, 6) as delta from fm join always using (label)""", "fx_prediction")
def metric_delta(spark, sf):
    pred = view(spark, sf, "fx_prediction")
    base = evaluate.class_metrics(evaluate.confusion(pred))
    other = evaluate.class_metrics(evaluate.confusion(pred.withColumn("classification", F.lit("unknown"))))
    return rounded(evaluate.metric_delta(base, other), ["base_f1", "other_f1", "delta"])


@query("stratified_split", """select event_id, classification, case when row_number() over (partition by classification order by sha1(cast(event_id as varchar)), event_id) <= round_even(0.8e0*count(*) over (partition by classification), 0) then 'train' else 'test' end as split from fx_prediction""", "fx_prediction")
def stratified_split(spark, sf):
    return split.stratified_split(view(spark, sf, "fx_prediction").select("event_id", "classification"), "classification", "event_id")


@query("facility_centroid", """select ord, round((y0+y0+y0+side+y0+side+y0)/5e0, 9) as lat, round((x0+x0+side+x0+side+x0+x0)/5e0, 9) as lon from fx_ring""", "fx_ring")
def facility_centroid(spark, sf):
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("side"), F.col("y0") + F.col("side")
    ring = F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    raw = view(spark, sf, "fx_ring").select(
        "ord", F.concat(F.lit("R"), F.col("ord").cast("string")).alias("facility_id"), F.lit(None).cast("string").alias("name"),
        F.lit("other").alias("facility_type"), F.array(F.array(ring)).alias("geom"), F.lit("Polygon").alias("geom_type"),
        F.create_map(F.lit("landuse"), F.lit("industrial")).alias("tags"))
    return layers.load_facilities(raw).select("ord", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def layer_rows(spark, sf):
    """Infrastructure rows with some coordinates absent or out of range."""
    k = F.col("ord")
    return infra(spark, sf).select(
        F.col("facility_type").alias("layer"), "ord", F.lit("Point").alias("geom_type"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.lit(95.0)).otherwise(F.col("lat")).alias("lat"), "lon")


@query("layer_profile", """with l as (select facility_type as layer, case when ord%17=0 then null when ord%19=0 then 95e0 else lat end as lat, lon from fx_infra)
select layer, count(*) as records, count(*) filter (lat is null) as missing_coordinates, count(*) filter (lat>90) as invalid_geometries, 'Point' as geometry_types, min(lon) filter (lat<=90) as west, min(lat) filter (lat<=90) as south,
 max(lon) filter (lat<=90) as east, max(lat) filter (lat<=90) as north from l group by layer""", "fx_infra")
def layer_profile(spark, sf):
    return layers.profile_layer(layer_rows(spark, sf))


@query("typed_layers", """select ord, facility_type, case when facility_type='power_plant' then case ord%4 when 0 then 'thermal' when 1 then 'hydro' when 2 then 'other' end end as power_plant_type from fx_infra""", "fx_infra")
def typed_layers(spark, sf):
    from emberline.sources.geojson import typed_layer
    k = F.col("ord") % 4
    kind = F.when(k == 0, "coal_power_plants").when(k == 1, "small_hydro_power_plants").when(k == 2, "nuclear").otherwise("")
    rows = infra(spark, sf).select("ord", "facility_type", F.lit("Point").alias("geom_type"), "lat", "lon",
                                   F.create_map(F.lit("layer"), kind, F.lit("plant_name"), F.col("name")).alias("props"))
    parts = [typed_layer(rows.filter(F.col("facility_type") == t).drop("facility_type"), t) for t in TYPES]
    return layers.union_layers(parts).select("ord", "facility_type", "power_plant_type")


@query("union_layers", "select facility_type, count(*) as n from (select facility_type from fx_infra union all select facility_type from fx_facility) group by 1", "fx_infra fx_facility")
def union_layers(spark, sf):
    out = layers.union_layers([infra(spark, sf), fac(spark, sf)])
    return out.groupBy("facility_type").agg(F.count(F.lit(1)).alias("n"))


CAL = """spans as (select source, min(chunk_date) as d0, max(chunk_date) as d1 from fx_landed group by source),
cal as (select source, cast(s as date) as d, least(cast(s as date)+4, d1) as e from (select source, d1, unnest(generate_series(d0, d1, interval 5 day)) as s from spans))"""


def calendar(spark, sf):
    spans = view(spark, sf, "fx_landed").groupBy("source").agg(F.min("chunk_date").alias("start"), F.max("chunk_date").alias("end"))
    return coverage.chunk_calendar(spans, 5)


@query("chunk_calendar", f"with {CAL} select source, strftime(d, '%Y-%m-%d') as chunk_start, strftime(e, '%Y-%m-%d') as chunk_end, e-d+1 as days from cal", "fx_landed")
def chunk_calendar(spark, sf):
    return calendar(spark, sf).select("source", F.col("chunk_start").cast("string").alias("chunk_start"),
                                      F.col("chunk_end").cast("string").alias("chunk_end"), F.col("days").cast("long").alias("days"))


@query("landing_coverage", """with spans as (select source, min(chunk_date) as d0, max(chunk_date) as d1 from fx_landed group by source),
days as (select source, cast(unnest(generate_series(d0, d1, interval 1 day)) as date) as d from spans), rec as (select source, chunk_date, count(*) as n from fx_landed group by 1, 2)
select days.source, strftime(d, '%Y-%m-%d') as chunk_start, coalesce(n, 0) as records, case when n is null then 'missing' else 'ok' end as status from days left join rec on rec.source=days.source and chunk_date=d""", "fx_landed")
def landing_coverage(spark, sf):
    landed = view(spark, sf, "fx_landed")
    spans = landed.groupBy("source").agg(F.min("chunk_date").alias("start"), F.max("chunk_date").alias("end"))
    cal = coverage.chunk_calendar(spans, 1)
    files = landed.groupBy("source", F.col("chunk_date").alias("chunk_start")).agg(F.count(F.lit(1)).alias("records"))
    return coverage.landing_coverage(cal, files).select("source", F.col("chunk_start").cast("string").alias("chunk_start"), "records", "status")


@query("missing_chunks", """with spans as (select source, min(chunk_date) as d0, max(chunk_date) as d1 from fx_landed group by source)
select s.source, strftime(d, '%Y-%m-%d') as chunk_start from (select source, cast(unnest(generate_series(d0, d1, interval 1 day)) as date) as d from spans) s where not exists (select 1 from fx_landed l where l.source=s.source and l.chunk_date=d)""", "fx_landed")
def missing_chunks(spark, sf):
    landed = view(spark, sf, "fx_landed")
    spans = landed.groupBy("source").agg(F.min("chunk_date").alias("start"), F.max("chunk_date").alias("end"))
    out = coverage.missing_chunks(coverage.chunk_calendar(spans, 1), landed.withColumnRenamed("chunk_date", "chunk_start"))
    return out.select("source", F.col("chunk_start").cast("string").alias("chunk_start"))



@query("row_multiplicity", """with e as (select satellite from fx_detection union all select satellite from fx_detection where event_id%10=0)
select satellite, count(*) as rows_in, count(*) as rows_out, 0 as differing from e group by 1""", "fx_detection")
def row_multiplicity(spark, sf):
    """The enrichment keeps every input row exactly as often as it came, repeated rows included."""
    from emberline.plans.enrich import enrich
    own = view(spark, sf, "fx_detection")
    before = own.unionByName(own.filter("event_id % 10 = 0")).drop("site", "conf_code", "bright_ti5")
    after = enrich(before, fac(spark, sf))
    return analytics.multiplicity_by(before, after, before.columns, "satellite")
