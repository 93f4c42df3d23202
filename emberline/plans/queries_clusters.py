"""Queries over clusters, splits and the training table."""

from pyspark.sql import functions as F

from emberline.operators import analytics, clusters, split
from emberline.plans import training
from emberline.plans.queries_spatial import ANOMALY, COUNTS, PAIRS, SCORE, det
from emberline.plans.registry import query


def cluster_sql(eps: int, name: str = "cl") -> str:
    """Connected components by label propagation over the event pairs."""
    return f"""{PAIRS.replace("pairs as", f"pairs_{name} as")},
{name}_links as materialized (select a as u, b as v from pairs_{name} where d <= {eps}),
{name}_prop(id, comp) using key (id) as (
  select event_id, event_id from fx_detection
  union (select l.u, min(p.comp) from {name}_prop p join {name}_links l on l.v = p.id join recurring.{name}_prop c on c.id = l.u
    group by l.u, c.comp having min(p.comp) < c.comp)),
{name} as materialized (select d.*, p.comp as cluster_id from fx_detection d join {name}_prop p on p.id = d.event_id)"""


def stats_sql(name: str = "cl") -> str:
    return f"""stats as (select cluster_id, count(*) as size, avg(latitude) as clat, avg(longitude) as clon, avg(frp) as frp_mean, max(frp) as frp_max,
 count(distinct cast(ts as date)) as distinct_dates, cast(floor((epoch_us(max(ts))-epoch_us(min(ts)))/864e8) as bigint) as span_days, min(ts) as first_ts from {name} group by cluster_id)"""


@query("eps_edges", f"""with {PAIRS}, spots as (select latitude, longitude, min(event_id) as id, count(*) as n from fx_detection group by 1, 2),
 placed as (select e.event_id, s.id, s.n from fx_detection e join spots s using (latitude, longitude))
select x.id as id1, y.id as id2, x.n as n1, y.n as n2, round(min(d), 3) as distance_m from pairs p join placed x on x.event_id = p.a join placed y on y.event_id = p.b
where d <= 500 and x.id < y.id group by 1, 2, 3, 4""", "fx_detection")
def eps_edges(spark, sf):
    return clusters.eps_edges(det(spark, sf), 500.0).withColumn("distance_m", F.round("distance_m", 3))


@query("clusters_500m", f"with recursive {cluster_sql(500)} select event_id, cluster_id from cl", "fx_detection")
def clusters_500m(spark, sf):
    return clusters.assign_clusters(det(spark, sf), 500.0).select("event_id", "cluster_id")


@query("clusters_1km", f"with recursive {cluster_sql(1000)} select event_id, cluster_id from cl", "fx_detection")
def clusters_1km(spark, sf):
    return clusters.assign_clusters(det(spark, sf), 1000.0).select("event_id", "cluster_id")


def stats_of(spark, sf, eps=500.0):
    return clusters.cluster_stats(clusters.assign_clusters(det(spark, sf), eps))


@query("cluster_stats", f"""with recursive {cluster_sql(500)}, {stats_sql()}, sat as (select cluster_id, string_agg(satellite || ':' || n, ',' order by satellite) as satellites from
 (select cluster_id, satellite, count(*) as n from cl group by 1, 2) group by 1)
select cluster_id, size, round(clat, 10) as centroid_lat, round(clon, 10) as centroid_lon, round(frp_mean, 10) as frp_mean, frp_max, distinct_dates, span_days,
 span_days + 1 as date_span_days, satellites from stats join sat using (cluster_id)""", "fx_detection")
def cluster_stats(spark, sf):
    out = stats_of(spark, sf)
    text = F.array_join(F.transform(F.map_entries("satellites"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("cluster_id", "size", F.round("centroid_lat", 10).alias("centroid_lat"), F.round("centroid_lon", 10).alias("centroid_lon"),
                      F.round("frp_mean", 10).alias("frp_mean"), "frp_max", "distinct_dates", "span_days", "date_span_days", text.alias("satellites"))


@query("cluster_summary", f"""with recursive {cluster_sql(1000)}, {stats_sql()}
select 'clusters' as metric, 0 as size, count(*) filter (size>=3) as value from stats union all
select 'noise_points', 0, cast(coalesce(sum(size) filter (size<3), 0) as bigint) from stats union all select 'spatial_groups', 0, count(*) from stats union all
select 'size', size, count(*) from stats where size >= 3 group by size""", "fx_detection")
def cluster_summary(spark, sf):
    return clusters.cluster_summary(stats_of(spark, sf, 1000.0))


@query("persistence_summary", f"""with recursive {cluster_sql(500)}, {stats_sql()} select count(*) as spatial_clusters, count(*) filter (size=1) as isolated, count(*) filter (size>=2) as repeated,
 count(*) filter (distinct_dates>=2) as multi_day, count(*) filter (span_days>=7) as multi_week, count(*) filter (size>=5 or distinct_dates>=3) as high_persistence from stats""", "fx_detection")
def persistence_summary(spark, sf):
    return clusters.persistence_summary(stats_of(spark, sf))


@query("top_clusters", f"""with recursive {cluster_sql(500)}, {stats_sql()}
select * from (select 'largest' as list, cluster_id, size, span_days from stats order by size desc, cluster_id limit 10)
union all select * from (select 'longest' as list, cluster_id, size, span_days from stats order by span_days desc, cluster_id limit 5)""", "fx_detection")
def top_clusters(spark, sf):
    stats = stats_of(spark, sf)
    cols = ["cluster_id", "size", "span_days"]
    largest = clusters.top_clusters(stats, "size", 10).select(F.lit("largest").alias("list"), *cols)
    return largest.unionByName(clusters.top_clusters(stats, "span_days", 5).select(F.lit("longest").alias("list"), *cols))


@query("cluster_features", f"""with recursive {cluster_sql(500)}, {stats_sql()} select event_id, cl.cluster_id, size as cluster_size_500, distinct_dates, span_days from cl join stats using (cluster_id)""", "fx_detection")
def cluster_features(spark, sf):
    clustered = clusters.assign_clusters(det(spark, sf), 500.0)
    return clusters.join_cluster_stats(clustered, clusters.cluster_stats(clustered)).select(
        "event_id", "cluster_id", "cluster_size_500", "distinct_dates", "span_days")


@query("candidate_score", f"""with recursive {cluster_sql(500)}, {stats_sql()}, j as (select cl.*, size, distinct_dates from cl join stats using (cluster_id)),
b as (select min(frp) f0, max(frp) f1, min(brightness_temperature) b0, max(brightness_temperature) b1, min(distinct_dates) d0, max(distinct_dates) d1, min(size) s0, max(size) s1 from j)
select event_id, round(0.4e0*(frp-f0)/(f1-f0+1e-9) + 0.2e0*(brightness_temperature-b0)/(b1-b0+1e-9) + 0.2e0*(distinct_dates-d0)/(d1-d0+1e-9) + 0.2e0*(size-s0)/(s1-s0+1e-9)
  + case when hour(ts) between 6 and 18 then 0e0 else 0.05e0 end, 6) as candidate_score from j, b order by 2 desc, event_id limit 20""", "fx_detection")
def candidate_score(spark, sf):
    clustered = clusters.assign_clusters(det(spark, sf), 500.0)
    joined = clusters.join_cluster_stats(clustered, clusters.cluster_stats(clustered))
    return analytics.candidate_score(joined).select("event_id", F.round("candidate_score", 6).alias("candidate_score"))


# First fit in time order, one cluster per recursion step: (rank, size) -> part.
SPLIT = """ranked as materialized (select cluster_id, size, row_number() over (order by first_ts, cluster_id) as rk from stats),
tot as (select cast(sum(size) as bigint) as n, cast(floor(sum(size)*0.15) as bigint) as n_val from ranked),
walk(rk, tr, va, part) as (
  select cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), '' union all
  select r.rk, case when in_train then tr + size else tr end, case when not in_train and in_val then va + size else va end,
    case when in_train then 'train' when in_val then 'val' else 'test' end
  from (select w.tr, w.va, r.rk, r.size, (w.tr < n - 2*n_val and (w.tr + r.size <= n - 2*n_val or r.rk = 1)) as in_train,
      (w.va < n_val and (w.va + r.size <= n_val or w.va = 0)) as in_val from walk w join ranked r on r.rk = w.rk + 1, tot) r),
parts as (select cluster_id, part from ranked join walk using (rk))"""


@query("spatial_temporal_split", f"with recursive {cluster_sql(500)}, {stats_sql()}, {SPLIT} select event_id, cl.cluster_id, part as split from cl join parts using (cluster_id)", "fx_detection")
def spatial_temporal_split(spark, sf):
    clustered = clusters.assign_clusters(det(spark, sf).select("event_id", "latitude", "longitude", "ts"), 500.0)
    return split.spatial_temporal_split(clustered).select("event_id", "cluster_id", "split")


@query("split_disjoint", f"""with recursive {cluster_sql(500)}, {stats_sql()}, {SPLIT}, j as (select cl.cluster_id, part from cl join parts using (cluster_id))
select part as split, count(*) as rows, count(distinct cluster_id) as clusters, (select count(*) from (select cluster_id from j group by 1 having count(distinct part) > 1)) as overlapping from j group by part""", "fx_detection")
def split_disjoint(spark, sf):
    clustered = clusters.assign_clusters(det(spark, sf).select("event_id", "latitude", "longitude", "ts"), 500.0)
    parts = split.spatial_temporal_split(clustered)
    overlap = split.split_overlap(parts).agg(F.count(F.lit(1)).alias("n")).scalar()
    return split.split_report(parts).withColumn("overlapping", overlap)


RULES = {
    "p": ("persistent_industrial_thermal_source", ["d7>=5", "s>=0.6e0", "prior+1>=5", "dd>=3", "sp>=5", "frp>=1e0 and frp<=15e0", "bt>=310 and bt<=350"]),
    "i": ("industrial_fire", ["frp>=7e0", "bt>=330", "d24>=2", "prior+1>=3 and prior+1<=15", "an>1e0", "s>=0.3e0 and s<=0.8e0"]),
    "g": ("gas_flare", ["s>=0.7e0", "d30>=10", "prior+1<=5", "dd>=5", "sp>=10", "frp>=3e0 and frp<=15e0", "bt>=320 and bt<=350"]),
    "w": ("wildfire", ["prior+1>10", "frp>=10", "bt>=340", "s>=0.2e0 and s<=0.6e0", "dd>=1 and dd<=2", "d7>0 and d30>0 and d7/greatest(1e0,d30)>0.5e0"]),
    "a": ("agricultural_fire", ["s<0.3e0", "sp<=2", "dd<=2", "d7<=3", "frp>=0.5e0 and frp<=7e0", "prior+1<=3", "bt>=300 and bt<=340"]),
}


def rules_sql(source: str, rules=RULES) -> str:
    """Label by counting satisfied rules; ``source`` supplies d24 d7 d30 s prior dd sp frp bt an."""
    hits = ", ".join(f"{' + '.join(f'cast(coalesce({r}, false) as int)' for r in rs)} as n_{k}" for k, (_, rs) in rules.items())
    ok = ", ".join(f"case when (n_{k}>=3 and n_{k}/{len(rs)}e0>=0.5e0) or (n_{k}>=4 and n_{k}/{len(rs)}e0>=0.4e0) then n_{k}/{len(rs)}e0 else 0e0 end as q_{k}" for k, (_, rs) in rules.items())
    best = "greatest(" + ", ".join(f"q_{k}" for k in rules) + ")"
    top = "greatest(" + ", ".join(f"n_{k}/{len(rs)}e0" for k, (_, rs) in rules.items()) + ")"
    pick = " ".join(f"when q_{k}={best} then '{c}'" for k, (c, _) in rules.items())
    return f"""hit as (select *, {hits} from {source}), elig as (select *, {ok} from hit),
labelled as (select *, case when {best}=0 then 'unknown' {pick} end as weak_label, round_even(case when {best}=0 then {top}*0.5e0 else {best} end, 3) as label_confidence,
 case when {best}>=0.7e0 then 'high' when {best}>=0.5e0 then 'medium' else 'low' end as confidence_level from elig)"""


@query("training_dataset", f"""with recursive {cluster_sql(500)}, {stats_sql()}, {PAIRS}, {COUNTS},
base as (select e.event_id, e.frp, e.brightness_temperature as bt, d24, d7, d30, prior, week, {SCORE} as s, {ANOMALY} as an, cl.cluster_id, st.size, st.distinct_dates as dd, st.span_days as sp,
   isodow(e.ts)-1 as dow, case when hour(e.ts) between 6 and 18 then 'D' else 'N' end as dn
  from counts join fx_detection e using (event_id) join cl using (event_id) join stats st on st.cluster_id = cl.cluster_id),
{rules_sql('base')}
select event_id, dow as day_of_week, dn as daynight, d24 as detections_24h, d7 as detections_7d, d30 as detections_30d, round(s, 6) as persistence, prior+1 as hotspot_cluster_size,
 round(prior/30e0, 6) as facility_baseline, round(week/7e0, 6) as facility_current_activity, round(an, 6) as facility_anomaly, size as cluster_size_500, dd as distinct_dates, sp as span_days, cluster_id,
 weak_label, label_confidence, confidence_level from labelled""", "fx_detection")
def training_dataset(spark, sf):
    out = training.training_dataset(det(spark, sf))
    return out.select("event_id", F.col("day_of_week").cast("long").alias("day_of_week"), "daynight", "detections_24h", "detections_7d", "detections_30d",
                      F.round("persistence", 6).alias("persistence"), "hotspot_cluster_size", F.round("facility_baseline", 6).alias("facility_baseline"),
                      F.round("facility_current_activity", 6).alias("facility_current_activity"), F.round("facility_anomaly", 6).alias("facility_anomaly"),
                      "cluster_size_500", "distinct_dates", "span_days", "cluster_id", "weak_label", "label_confidence", "confidence_level")


@query("label_distribution", f"""with recursive {cluster_sql(500)}, {stats_sql()}, {PAIRS}, {COUNTS},
base as (select e.event_id, e.frp, e.brightness_temperature as bt, d24, d7, d30, prior, week, {SCORE} as s, {ANOMALY} as an, st.distinct_dates as dd, st.span_days as sp
  from counts join fx_detection e using (event_id) join cl using (event_id) join stats st on st.cluster_id = cl.cluster_id),
{rules_sql('base')}
select 'label' as metric, weak_label as key, cast(count(*) as double) as value from labelled group by weak_label union all select 'total', '', count(*) from labelled
union all select 'unknown_pct', '', round(100e0*count(*) filter (weak_label='unknown')/count(*), 2) from labelled union all select 'low_confidence', '', count(*) filter (label_confidence<0.5e0) from labelled
union all select 'low_confidence_pct', '', round(100e0*count(*) filter (label_confidence<0.5e0)/count(*), 2) from labelled""", "fx_detection")
def label_distribution(spark, sf):
    return analytics.label_distribution(training.training_dataset(det(spark, sf)))


LABEL_FEATURES = ("detections_24h", "detections_7d", "detections_30d", "hotspot_cluster_size", "distinct_dates", "span_days")


@query("leakage_overlap", " union all ".join(f"select '{c}' as feature from fx_context having count({c}) > 0" for c in LABEL_FEATURES), "fx_context")
def leakage_overlap(spark, sf):
    from emberline.fixtures import view
    return split.leakage_overlap(training.label_feature_names(spark), training.training_feature_names(view(spark, sf, "fx_context")))
