"""Queries over labels, classes, risk, explanations and the scoring job."""

from pyspark.sql import functions as F

from emberline.fixtures import view
from emberline.functions.timefeat import anomaly_level as anomaly_level_of
from emberline.operators import classify, explain, labels, risk
from emberline.operators.features import engineer
from emberline.plans import scoring
from emberline.plans.queries_clusters import rules_sql
from emberline.plans.registry import query


def context(spark, sf):
    return view(spark, sf, "fx_context")


def tracker(spark, sf):
    return view(spark, sf, "fx_tracker")


# Engineered inputs restated for the checks.
ENG = """eng as (select *, case when facility_baseline is null or current_activity is null then null when facility_baseline > 0 then (current_activity-facility_baseline)/facility_baseline else current_activity end as an,
  case when facility_baseline > 0 then current_activity/facility_baseline end as ratio,
  coalesce(facility_type in ('refinery','gas'), false) as flare, coalesce(facility_type in ('refinery','power_plant','steel','gas','chemical'), false) as ind,
  distance_to_facility_m as df, distance_to_forest_m as dfo, distance_to_agriculture_m as da, persistence_score as p, detections_24h as n24, detections_7d as n7, detections_30d as n30,
  hotspot_cluster_size as hs, confidence as sc from fx_context)"""
SCORES = f"""{ENG}, sc0 as (select *,
 greatest(0e0, (case when df<500 then 2.5e0 when df<2000 then 1.2e0 when df<5000 then 0.3e0 when df>=5000 then -0.5e0 else 0e0 end) + (case when ind then 1.5e0 else 0e0 end)
  + (case when frp>=100 then 1.5e0 when frp>=50 then 0.8e0 when frp>=20 then 0.3e0 else 0e0 end) + (case when p>=0.75e0 then 0.5e0 when p>=0.6e0 then 0.3e0 else 0e0 end)
  + (case when ndbi>0.3e0 then 0.6e0 else 0e0 end) + (case when ndvi<0.2e0 then 0.4e0 when ndvi>0.4e0 then -0.5e0 else 0e0 end)
  + (case when an>1e0 then 1e0 when an>0.5e0 then 0.5e0 else 0e0 end) + (case when sc>=80 then 0.3e0 else 0e0 end)
  + (case when flare and p>=0.75e0 then -1.2e0 else 0e0 end) + (case when flare and p>=0.75e0 and an>=2 then 1e0 else 0e0 end)) as s1,
 greatest(0e0, (case when p>=0.75e0 then 2.5e0 when p>=0.6e0 then 1.2e0 when p>=0.3e0 then 0.4e0 when p is not null then -0.3e0 else 0e0 end)
  + (case when n7>=10 then 1.2e0 when n7>=5 then 0.6e0 else 0e0 end) + (case when n30>=20 then 1e0 else 0e0 end) + (case when n24>=5 then 0.5e0 else 0e0 end)
  + (case when df<500 then 1.5e0 when df<2000 then 0.8e0 else 0e0 end) + (case when ind then 0.8e0 else 0e0 end)) as s2,
 greatest(0e0, case when flare then 3.5e0 + (case when p>=0.85e0 then 1.8e0 when p>=0.6e0 then 1.2e0 else 0e0 end) + (case when frp>=10 and frp<=120 then 0.8e0 else 0e0 end)
   + (case when df<1000 then 0.9e0 else 0e0 end) + (case when ndbi>0.2e0 then 0.4e0 else 0e0 end) + (case when n7>=15 then 0.9e0 when n7>=7 then 0.4e0 else 0e0 end) + (case when n30>=30 then 0.6e0 else 0e0 end)
   else -0.5e0 + (case when df<500 and p>=0.7e0 then 0.5e0 else 0e0 end) end) as s3,
 greatest(0e0, (case when dfo<2000 then 2e0 else 0e0 end) + (case when dfo<500 then 0.8e0 else 0e0 end) + (case when ndvi>0.4e0 then 1.2e0 when ndvi>0.2e0 then 0.4e0 else 0e0 end)
   + (case when hs>=5 then 1.2e0 when hs>=3 then 0.6e0 else 0e0 end) + (case when df is null or df>5000 then 0.8e0 when df<500 then -1e0 else 0e0 end)
   + (case when frp>=50 then 0.5e0 else 0e0 end) + (case when ndbi<0 then 0.3e0 else 0e0 end) + (case when ind then -0.5e0 else 0e0 end)) as s4,
 greatest(0e0, (case when da<2000 then 2e0 else 0e0 end) + (case when da<500 then 0.5e0 else 0e0 end) + (case when p<0.6e0 then 0.6e0 when p>=0.75e0 then -0.5e0 else 0e0 end)
   + (case when df>2000 then 0.8e0 when df<500 then -0.8e0 else 0e0 end) + (case when frp<50 then 0.5e0 when frp>100 then -0.4e0 else 0e0 end)
   + (case when ndvi>0.2e0 and ndvi<0.6e0 then 0.3e0 else 0e0 end) + (case when n7<=3 then 0.3e0 else 0e0 end)) as s5 from eng),
sc1 as (select *, case when greatest(s1,s2,s3,s4,s5) < 0.8e0 then 1e0 when greatest(s1,s2,s3,s4,s5) < 1.5e0 then 0.3e0 else 0.1e0 end as s6 from sc0),
sc2 as (select *, list_sort([s1,s2,s3,s4,s5,s6], 'DESC') as ranked, s1+s2+s3+s4+s5+s6 as tot from sc1),
sc3 as (select *, ranked[1] as top, ranked[1]-ranked[2] as gap, case ranked[1] when s1 then 'industrial_fire' when s2 then 'persistent_industrial_thermal_source' when s3 then 'gas_flare'
   when s4 then 'wildfire' when s5 then 'agricultural_fire' else 'unknown' end as classification from sc2),
sc4 as (select *, (0.55e0*(top/tot) + 0.45e0*least(gap/greatest(1e0, top), 1e0))*0.8e0 + (sc/100e0)*0.2e0 as rw from sc3),
sc5 as (select *, 0.5e0 + (case when classification='unknown' then least(rw, 0.62e0) else rw end)*0.47e0 as c0 from sc4),
classed as (select *, round_even(greatest(0e0, least(1e0, case when gap>=1.5e0 then least(0.97e0, c0+0.05e0) else c0 end)), 3) as cc from sc5)"""


@query("classify", f"with {SCORES} select event_id, classification, cc as class_confidence from classed", "fx_context")
def classify_query(spark, sf):
    return classify.classify_baseline(engineer(context(spark, sf))).select("event_id", "classification", "class_confidence")


RISK = """risked as (select *, cast(round_even(greatest(0e0, least(100e0,
  (case when frp>=180 then 25e0 when frp>=100 then 18e0+(frp-100)/80e0*7e0 when frp>=50 then 10e0+(frp-50)/50e0*8e0 when frp>=20 then 4e0+(frp-20)/30e0*6e0 else frp/20e0*4e0 end)
  + (case when brightness_temperature>=360 then 5e0 when brightness_temperature>=340 then 3e0 when brightness_temperature>=310 then 1e0 else 0e0 end) + sc/100e0*5e0
  + (case when df<200 then 20e0 when df<500 then 16e0 when df<2000 then 10e0 when df<5000 then 4e0 when df is not null then 1e0 when ind then 8e0 else 0e0 end)
  + (case when facility_type in ('refinery','chemical','power_plant','gas') then 5e0 when ind then 2e0 else 0e0 end)
  + (case when p is not null then p*15e0 else least(n7/14e0*10e0, 10e0) end) + (case when p is null and n24>=3 then 3e0 else 0e0 end)
  + (case when hs>=5 then 5e0 when hs>=3 then 2e0 else 0e0 end)
  + (case when an>=5 then 20e0 when an>=2 then 14e0 when an>=1 then 10e0 when an>=0.5e0 then 6e0 when an>=0 then 2e0 else 0e0 end)
  + (case when ndvi<0.2e0 and ndbi>0.3e0 then 2e0 else 0e0 end)
  + (case classification when 'industrial_fire' then 4e0 when 'persistent_industrial_thermal_source' then 2e0 when 'gas_flare' then 1e0 when 'wildfire' then 3e0 when 'agricultural_fire' then -4e0 else -6e0 end)
  + (case when classification='gas_flare' and (an is null or an<0.5e0) and frp<50 then -8e0 else 0e0 end)
  + (case when classification='persistent_industrial_thermal_source' and (an is null or an<0.5e0) then -5e0 else 0e0 end))), 0) as int) as risk_score from classed)"""
LEVEL = "case when risk_score>=75 then 'CRITICAL' when risk_score>=50 then 'HIGH' when risk_score>=30 then 'MODERATE' else 'LOW' end"


@query("risk_score", f"with {SCORES}, {RISK} select event_id, risk_score, {LEVEL} as risk_level from risked", "fx_context")
def risk_query(spark, sf):
    return risk.risk_score(classify.classify_baseline(engineer(context(spark, sf)))).select("event_id", "risk_score", "risk_level")


@query("triage", f"""with {SCORES}, {RISK} select event_id, case when risk_score>=75 then 'tier1_alert' when risk_score>=50 then 'monitoring' else 'store_only' end as action,
 cast(risk_score>=75 as int) as triage_required, case when risk_score>=75 then 1 end as recommended_tier from risked""", "fx_context")
def triage_query(spark, sf):
    out = risk.triage(risk.risk_score(classify.classify_baseline(engineer(context(spark, sf)))))
    return out.select("event_id", "action", F.col("triage_required").cast("int").alias("triage_required"), "recommended_tier")


LINES = """least(6, (case when frp>=50 or frp<10 then 1 else 0 end) + cast(brightness_temperature>=340 as int)
 + cast(coalesce(df<2000 or df>5000, ind) as int)
 + cast((flare and classification='gas_flare') or (ind and classification in ('industrial_fire','persistent_industrial_thermal_source')) as int)
 + cast(coalesce(p>=0.6e0 or p<0.3e0, false) as int) + cast(n7>=10 and p is null as int) + cast(n24>=4 as int) + cast(coalesce(an>=0.5e0 or an<0, false) as int)
 + cast(coalesce(ndvi>0.4e0 or ndvi<0.2e0, false) as int) + cast(coalesce(ndbi>0.3e0 or ndbi<0, false) as int) + cast(coalesce(dfo<2000, false) as int) + cast(coalesce(da<2000, false) as int)
 + cast(hs>=3 as int) + cast(cc<0.6e0 as int))"""


@query("explain_count", f"with {SCORES} select event_id, greatest(1, {LINES}) as sentences from classed", "fx_context")
def explain_count(spark, sf):
    return explain.explain(classify.classify_baseline(engineer(context(spark, sf)))).select("event_id", F.size("explanation").alias("sentences"))


@query("explain")
def explain_query(spark, sf):
    return explain.explain(classify.classify_baseline(engineer(context(spark, sf)))).select("event_id", "explanation")


@query("predict", f"""with {SCORES}, {RISK} select event_id, classification, cc as confidence, risk_score, {LEVEL} as risk_level, case when risk_score>=75 then 1 end as recommended_tier,
 case when risk_score>=75 then 'tier1_alert' when risk_score>=50 then 'monitoring' else 'store_only' end as action, greatest(1, {LINES}) as sentences, round(ratio, 6) as anomaly_ratio,
 p as persistence_score, 'baseline-v0' as model_version from risked""", "fx_context")
def predict_query(spark, sf):
    out = scoring.predict(context(spark, sf))
    return out.select("event_id", "classification", "confidence", "risk_score", "risk_level", "recommended_tier", "action",
                      F.size("explanation").alias("sentences"), F.round("anomaly_ratio", 6).alias("anomaly_ratio"), "persistence_score", "model_version")


@query("anomaly_level", """select event_id, case when facility_baseline is null or current_activity is null then 'unknown'
 when facility_baseline=0 then case when current_activity>3 then 'high' when current_activity<>0 then 'moderate' else 'unknown' end
 when (current_activity-facility_baseline)/facility_baseline>=5 then 'critical' when (current_activity-facility_baseline)/facility_baseline>=2 then 'high'
 when (current_activity-facility_baseline)/facility_baseline>=0.5e0 then 'moderate' else 'low' end as anomaly_level from fx_context""", "fx_context")
def anomaly_level(spark, sf):
    out = engineer(context(spark, sf))
    return out.select("event_id", anomaly_level_of(F.col("facility_baseline"), F.col("current_activity"), F.col("activity_anomaly")).alias("anomaly_level"))


def label_source(dd: str, sp: str, name: str = "base") -> str:
    return f"""{name} as (select event_id, frp, brightness_temperature as bt, detections_24h as d24, detections_7d as d7, detections_30d as d30, hotspot_cluster_size-1 as prior,
 coalesce(persistence_score, 0e0) as s, case when facility_baseline>0 then (current_activity-facility_baseline)/facility_baseline else current_activity end as an, {dd} as dd, {sp} as sp from fx_context)"""


def label_input(spark, sf):
    base, cur = F.col("facility_baseline"), F.col("current_activity")
    return context(spark, sf).withColumn("persistence", F.col("persistence_score")).withColumn(
        "activity_anomaly", F.when(base > 0, (cur - base) / F.nullif(base, F.lit(0.0))).otherwise(cur))


@query("weak_labels", f"with {label_source('distinct_dates', 'span_days')}, {rules_sql('base')} select event_id, weak_label, label_confidence, confidence_level from labelled", "fx_context")
def weak_labels(spark, sf):
    return labels.weak_label(label_input(spark, sf)).select("event_id", "weak_label", "label_confidence", "confidence_level")


@query("weak_labels_approx", f"""with {label_source('least(cast(floor(detections_7d/2e0) as bigint)+1, 7)', '2*least(cast(floor(detections_7d/2e0) as bigint)+1, 7)')}, {rules_sql('base')}
select event_id, weak_label, label_confidence, confidence_level from labelled""", "fx_context")
def weak_labels_approx(spark, sf):
    return labels.weak_label(label_input(spark, sf).drop("distinct_dates", "span_days")).select(
        "event_id", "weak_label", "label_confidence", "confidence_level")


BACKGROUND = "frp<3 and temp_diff_ti4_ti5<20 and is_night=0 and min_distance_to_industrial_km>3"
EVIDENCE = f"""case when {BACKGROUND} then 'NORMAL_OR_BACKGROUND_HEAT'
 when distance_to_flare_km<=1.5e0 and (temp_diff_ti4_ti5>=20 or is_night=1 or spatial_persistence_count>=2) then 'PERSISTENT_FLARE_HOTSPOT'
 when distance_to_plant_km<=2 and frp>=3 then 'INDUSTRIAL_FACILITY_ALERT' when distance_to_coal_mine_km<=3.5e0 and frp>=3 then 'COAL_MINE_THERMAL_SOURCE'
 when min_distance_to_industrial_km>=15 and (frp>=3 or temp_diff_ti4_ti5>=25) then 'ACTIVE_WILDFIRE_OR_FOREST_FIRE' else 'UNCONFIRMED_INTERMEDIATE' end"""


@query("evidence_labels", f"""select event_id, weak_supervision_label, case when weak_supervision_label in ('PERSISTENT_FLARE_HOTSPOT','INDUSTRIAL_FACILITY_ALERT','COAL_MINE_THERMAL_SOURCE') then 1
 when weak_supervision_label in ('NORMAL_OR_BACKGROUND_HEAT','ACTIVE_WILDFIRE_OR_FOREST_FIRE') then 0 else -1 end as is_industrial_candidate from (select event_id, {EVIDENCE} as weak_supervision_label from fx_tracker)""", "fx_tracker")
def evidence_labels(spark, sf):
    return labels.evidence_label(tracker(spark, sf)).select("event_id", "weak_supervision_label", "is_industrial_candidate")


DETAILED = f"""case when {BACKGROUND} then 'Normal Background / Non-Fire Solar Heating' when coalesce(prob_industrial,0)<0.5e0 then 'Active Wildfire / Forest Fire'
 when min_distance_to_industrial_km=distance_to_flare_km then 'Gas Flare / Upstream Thermal Source' when min_distance_to_industrial_km=distance_to_plant_km then concat('Industrial Facility Alert (', coalesce(nearest_plant_fuel,'Plant'), ')') else 'Coal Mine Thermal Alert' end"""


def detailed(spark, sf):
    return labels.detailed_class(labels.evidence_label(tracker(spark, sf)).withColumn(
        "is_industrial", F.coalesce(F.col("prob_industrial"), F.lit(0.0)) >= 0.5))


@query("detailed_class", f"select event_id, {DETAILED} as detailed_predicted_class from fx_tracker", "fx_tracker")
def detailed_class(spark, sf):
    return detailed(spark, sf).select("event_id", "detailed_predicted_class")


@query("fallback_class", """select event_id, case when coalesce(distance_to_facility_m,10000)<500 and frp>80 then 'industrial_fire' when coalesce(distance_to_facility_m,10000)<300 and coalesce(persistence_score,0)>0.7e0 then 'persistent_industrial_source' else 'wildfire' end as classification,
 case when coalesce(distance_to_facility_m,10000)<500 and frp>80 then 88e0 when coalesce(distance_to_facility_m,10000)<300 and coalesce(persistence_score,0)>0.7e0 then 65e0 else 55e0 end as risk_score from fx_context""", "fx_context")
def fallback_class(spark, sf):
    return labels.fallback_class(context(spark, sf)).select("event_id", "classification", "risk_score")


REFINE = f"""{ENG}, prob as (select *, ((event_id*37)%101)/1e2 as pi from eng)"""


@query("refine_label", f"""with {REFINE} select event_id, case when pi>=0.5e0 then case when flare then 'gas_flare' when p>=0.75e0 then 'persistent_industrial_thermal_source' when an>1e0 or df<=2000 then 'industrial_fire' else 'persistent_industrial_thermal_source' end
 else case when coalesce(nullif(dfo,0),9999)<2000 or coalesce(ndvi>0.4e0,false) then 'wildfire' when coalesce(nullif(da,0),9999)<2000 then 'agricultural_fire' else 'unknown' end end as classification,
 round_even(case when pi>=0.5e0 then least(0.98e0, greatest(0.55e0, pi)) else least(0.98e0, greatest(0.5e0, 1e0-pi)) end, 3) as class_confidence from prob""", "fx_context")
def refine_label(spark, sf):
    base = engineer(context(spark, sf)).withColumn("prob_industrial", F.col("event_id") * 37 % 101 / 100.0)
    return classify.refine_label(base).select("event_id", "classification", "class_confidence")


@query("map_record", f"""with d as (select *, {DETAILED} as c from fx_tracker), m as (select *, case when prob_industrial>=0.5e0 then cast(floor(prob_industrial*90e0+0.5e0) as int) when prob_industrial<0.5e0 then 35 end as risk from d)
select event_id, case when c like '%Flare%' then 'Gas Flare' when c like '%Wildfire%' or c like '%Forest%' then 'Wildfire/Natural Fire' when c like '%Industrial%' or c like '%Plant%' or c like '%Coal%' then 'Industrial Fire'
 when c like '%Normal%' or c like '%Background%' then 'Unknown' else 'Industrial Fire' end as fire_type, risk as map_risk, case when risk>=80 then 'critical' when risk>=60 then 'high' when risk is not null then 'moderate' end as map_risk_level,
 least(15*spatial_persistence_count, 95) as map_persistence, case confidence when 'high' then 95 when 'nominal' then 80 else 65 end as sensor_confidence from m""", "fx_tracker")
def map_record(spark, sf):
    return labels.map_record(detailed(spark, sf)).select("event_id", "fire_type", "map_risk", "map_risk_level", "map_persistence", "sensor_confidence")


@query("explain_tracker_count", """select event_id, 1 + cast(distance_to_plant_km<=3 as int) + cast(distance_to_flare_km<=2 as int) + cast(temp_diff_ti4_ti5>=20 as int) + cast(spatial_persistence_count*15>=60 as int) as sentences from fx_tracker""", "fx_tracker")
def explain_tracker_count(spark, sf):
    return explain.explain_tracker(labels.map_record(detailed(spark, sf))).select("event_id", F.size("tracker_reasons").alias("sentences"))


@query("map_layers", f"""with d as (select *, {DETAILED} as c from fx_tracker) select case when lower(c) like '%flare%' then 'flares' when lower(c) like '%wildfire%' or lower(c) like '%natural%' or lower(c) like '%forest%' then 'wildfires'
 when lower(c) like '%normal%' or lower(c) like '%background%' then 'normal' else 'industrial' end as layer, count(*) as n from d group by 1""", "fx_tracker")
def map_layers(spark, sf):
    return detailed(spark, sf).groupBy(labels.map_layer(F.col("detailed_predicted_class")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query("map_counts", f"""with d as (select {DETAILED} as c from fx_tracker) select count(*) as total, count(*) filter (regexp_matches(c, '(?i)Industrial|Coal|Flare')) as industrial_alerts, count(*) filter (regexp_matches(c, '(?i)Wildfire|Forest')) as wildfires,
 count(*) filter (regexp_matches(c, '(?i)Normal|Background')) as normal_background from d""", "fx_tracker")
def map_counts(spark, sf):
    from emberline.operators import analytics
    return analytics.map_counts(detailed(spark, sf))


@query("model_features")
def model_features(spark, sf):
    return classify.model_features(engineer(context(spark, sf))).select("event_id", *classify.MODEL_NUMERIC, *classify.MODEL_CATEGORICAL)
