"""Queries over alerts and served views."""

from pyspark.sql import functions as F

from emberline.fixtures import view
from emberline.operators import alerts, serving
from emberline.plans.registry import query
from emberline.session import cut

# The fold restated with window functions: first eligible escalation per tier.
FOLD = """o as (select *, row_number() over (partition by alert_id order by "at", seq) as rk from fx_alert_action),
e1 as (select alert_id, min(rk) as r1 from o where action='ESCALATE' and (caller_tier is null or caller_tier=1) group by 1),
e2 as (select o.alert_id, min(rk) as r2 from o join e1 using (alert_id) where action='ESCALATE' and rk>r1 and (caller_tier is null or caller_tier=2) group by 1),
marked as (select o.*, 1 + cast(coalesce(rk>r1,false) as int) + cast(coalesce(rk>r2,false) as int) as tier, action<>'ESCALATE' or coalesce(rk=r1,false) or coalesce(rk=r2,false) as accepted
 from o left join e1 using (alert_id) left join e2 using (alert_id)),
folded as (select alert_id, case arg_max(action, rk) when 'ACKNOWLEDGE' then 'ACKNOWLEDGED' when 'ESCALATE' then 'ESCALATED' else 'RESOLVED' end as status,
 1 + count(*) filter (action='ESCALATE') as current_tier, count(*) as history_entries, arg_max(tier, rk) filter (action='RESOLVE') as resolved_tier, max(rk) as last_rk from marked where accepted group by alert_id),
al as (select f.*, region, severity from folded f join fx_alert_info using (alert_id))"""
V = "fx_alert_action fx_alert_info"


def actions(spark, sf):
    return view(spark, sf, "fx_alert_action")


def alert_table(spark, sf):
    return alerts.fold_alerts(actions(spark, sf)).join(view(spark, sf, "fx_alert_info"), "alert_id")


@query("alert_lifecycle", f"""with {FOLD} select alert_id, status, current_tier, current_tier-1 as previous_tier, history_entries, resolved_tier,
 case current_tier when 2 then 'State Disaster Management Authority (SDMA)' when 3 then 'National Disaster Management Authority (NDMA Central)' else 'Tier 1 Local Response' end as assigned_agency from folded""", V)
def alert_lifecycle(spark, sf):
    return alerts.fold_alerts(actions(spark, sf)).select("alert_id", "status", F.col("current_tier").cast("long").alias("current_tier"),
        F.col("previous_tier").cast("long").alias("previous_tier"), "history_entries", "resolved_tier", "assigned_agency")


@query("alert_history", f"with {FOLD} select alert_id, seq, action, tier as from_tier, tier + cast(action='ESCALATE' as int) as to_tier from marked where accepted", V)
def alert_history(spark, sf):
    return alerts.alert_history(actions(spark, sf)).select("alert_id", "seq", "action", "from_tier", "to_tier")


@query("alert_rejects", f"with {FOLD} select alert_id, seq, caller_tier, tier, case when tier>=3 then 'at_top_tier' else 'caller_tier_mismatch' end as reject_reason from marked where not accepted", V)
def alert_rejects(spark, sf):
    return alerts.rejected_actions(actions(spark, sf))


@query("new_alerts", "select concat('ALT_', cast(event_id as string)) as alert_id, event_id, classification, risk_score, 'critical' as severity, 'NEW' as status, 1 as current_tier from fx_prediction where risk_score>=75", "fx_prediction")
def new_alerts(spark, sf):
    return alerts.new_alerts(view(spark, sf, "fx_prediction")).select("alert_id", "event_id", "classification", "risk_score", "severity", "status", "current_tier")


@query("alerts_view", f"""with {FOLD} select 'tier2_escalated' as list, alert_id from al where current_tier<=2 and (status='ESCALATED' or current_tier>1)
union all select 'open_critical', alert_id from al where status<>'RESOLVED' and severity='critical' union all select 'acknowledged_region', alert_id from al where status='ACKNOWLEDGED' and region='Gujarat'
union all select 'everything', alert_id from al""", V)
def alerts_view(spark, sf):
    table = alert_table(spark, sf)
    lists = {"tier2_escalated": alerts.alerts_view(table, tier=2, status="escalated"),
             "open_critical": alerts.alerts_view(table, status="UNRESOLVED", severity="Critical"),
             "acknowledged_region": alerts.alerts_view(table, status="acknowledged", region="gujar", include_resolved=False),
             "everything": alerts.alerts_view(table, status="all", severity="all", region="All India")}
    out = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("list"), "alert_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("alert_summary", f"""with {FOLD} select count(*) filter (status<>'RESOLVED' and severity='critical') as critical, count(*) filter (status<>'RESOLVED' and severity='high') as high,
 count(*) filter (status<>'RESOLVED') as unresolved, count(*) filter (status='RESOLVED') as resolved, count(*) filter (status<>'RESOLVED' and current_tier=1) as open_tier1,
 count(*) filter (status<>'RESOLVED' and current_tier=2) as open_tier2, count(*) filter (status<>'RESOLVED' and current_tier=3) as open_tier3 from al""", V)
def alert_summary(spark, sf):
    return alerts.alert_summary(alert_table(spark, sf))


@query("tier_queue", f"""with {FOLD}, op as (select * from al where status<>'RESOLVED') select t.tier, alert_id from op, (values (1),(2),(3),(4)) t(tier)
 where current_tier=t.tier or not exists (select 1 from op o2 where o2.current_tier=t.tier)""", V)
def tier_queue(spark, sf):
    table = cut(alert_table(spark, sf).select("alert_id", "status", "current_tier"))        # each tier reads it twice
    out = None
    for tier in (1, 2, 3, 4):
        part = alerts.tier_queue(table, tier).select(F.lit(tier).alias("tier"), "alert_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("alert_routing", f"with {FOLD} select user_id, alert_id, status from al join fx_user u on u.role='Central Government' or u.region=al.region", V + " fx_user")
def alert_routing(spark, sf):
    return alerts.route_alerts(alert_table(spark, sf), view(spark, sf, "fx_user").select("user_id", "role", "region")
                               ).select("user_id", "alert_id", "status")


EV = "fx_event_facility fx_prediction fx_facility"
SUMMARY = """summ as (select e.event_id, facility_id, coalesce(classification,'unknown') as classification, coalesce(p.confidence, 0e0) as confidence, coalesce(risk_score, 0) as risk_score, coalesce(risk_level,'low') as risk_level,
 coalesce(f.name, e.nearest_facility_name) as facility_name, coalesce(f.facility_type, e.facility_type) as facility_type from fx_event_facility e left join fx_prediction p using (event_id) left join fx_facility f using (facility_id))"""


def served(spark, sf):
    return view(spark, sf, "fx_event_facility"), view(spark, sf, "fx_prediction"), view(spark, sf, "fx_facility")


@query("event_summary", f"with {SUMMARY} select * from summ", EV)
def event_summary(spark, sf):
    return serving.event_summary(*served(spark, sf)).select("event_id", "facility_id", "classification", "confidence", "risk_score", "risk_level", "facility_name", "facility_type")


@query("event_search", f"""with {SUMMARY} select 'class' as list, event_id from summ where classification='gas_flare' and risk_level='HIGH' union all select 'facility', event_id from summ where facility_id='F12'
 union all select 'text', event_id from summ where lower(concat(cast(event_id as string), ' ', facility_name)) like '%near 1%'""", EV)
def event_search(spark, sf):
    table = serving.event_summary(*served(spark, sf))
    parts = {"class": serving.filter_events(table, classification="GAS_FLARE", risk_level="high"),
             "facility": serving.filter_events(table, facility_id="F12"), "text": serving.filter_events(table, search="Near 1")}
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("list"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("category_search", "select event_id from (select event_id, case when min_distance_to_industrial_km>15 then 'Active Wildfire' else 'Gas Flare' end as d, case when is_night=1 then 'FOREST_FIRE' else 'NORMAL' end as w from fx_tracker) where lower(d) like '%fire%' or lower(w) like '%fire%'", "fx_tracker")
def category_search(spark, sf):
    base = view(spark, sf, "fx_tracker").select(
        "event_id", F.when(F.col("min_distance_to_industrial_km") > 15, "Active Wildfire").otherwise("Gas Flare").alias("detailed_predicted_class"),
        F.when(F.col("is_night") == 1, "FOREST_FIRE").otherwise("NORMAL").alias("weak_supervision_label"))
    return serving.category_filter(base, "Fire").select("event_id")


@query("priority_view", "select event_id, risk_score from fx_prediction where risk_score>=50 order by risk_score desc, event_id limit 100", "fx_prediction")
def priority_view(spark, sf):
    return serving.priority_view(view(spark, sf, "fx_prediction"), 100).select("event_id", "risk_score")


@query("event_detail")
def event_detail(spark, sf):
    events, predictions, facilities = served(spark, sf)
    texts = predictions.withColumn("explanation", F.to_json(F.array(F.col("classification"), F.col("risk_level"))))
    return serving.event_detail(events, texts, facilities)


@query("facility_activity", """with a as (select facility_id, count(*) as n, sum(case when detections_24h=0 then 1 else detections_24h end) as r, count(*) filter (risk_level='CRITICAL') as c from fx_event_facility left join fx_prediction using (event_id) group by 1),
j as (select f.facility_id, f.name, coalesce(n,0) as total_detections, cast(coalesce(r,0) as bigint) as r, coalesce(c,0) as critical_incidents from fx_facility f left join a using (facility_id))
select facility_id, name, total_detections, r as recent_24h_detections, critical_incidents, case when r>3 or critical_incidents>0 then 'abnormal' else 'normal' end as abnormality_status,
 case when r>0 then round_even((r-1.5e0)/1.5e0*100, 1) else 0e0 end as deviation_percentage from j""", EV)
def facility_activity(spark, sf):
    events, predictions, facilities = served(spark, sf)
    return serving.facility_activity(facilities, events, predictions).drop("facility_type")


@query("facility_events", "select facility_id, event_id, frp, classification, risk_score from fx_event_facility left join fx_prediction using (event_id)", EV)
def facility_events(spark, sf):
    events, predictions, _ = served(spark, sf)
    return serving.facility_events(events, predictions).select("facility_id", "event_id", "frp", "classification", "risk_score")


@query("attach_features", """select e.event_id, ndvi, cast(coalesce(case when ndbi>0 then 1 when ndbi<=0 then 0 end, 0) as int) as built_present, cast(null as double) as absent_m from fx_detection e left join fx_context c using (event_id)""", "fx_detection fx_context")
def attach_features(spark, sf):
    feats = view(spark, sf, "fx_context").select("event_id", "ndvi", (F.col("ndbi") > 0).cast("int").alias("built_present"))
    base = view(spark, sf, "fx_detection").select("event_id")
    return serving.attach_features(base, feats, "event_id", ["ndvi", "absent_m"], ["built_present"])


@query("attach_split", "select event_id, case when substr(sha1(cast(event_id as varchar)),1,1) < 'c' then 'train' else 'test' end as split from fx_detection", "fx_detection")
def attach_split(spark, sf):
    from emberline.operators.split import attach_split as attach
    base = view(spark, sf, "fx_detection").select("event_id")
    parts = base.select("event_id", F.when(F.substring(F.sha1(F.col("event_id").cast("string")), 1, 1) < "c", "train").otherwise("test").alias("split"))
    return attach(base, parts, "event_id")
