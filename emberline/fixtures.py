"""Views that map the synthetic star-schema tables onto detection-shaped inputs.

The text of each view runs unchanged in Spark SQL and in the checking engine.
Sources are named in ``uses``; a view may build on another view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_detection": (("events",), """
select event_id, concat('D', cast(event_id as string)) as id, user_id as site,
  (800000 + ((user_id*37)%251)*10000 + ((event_id*17)%101-50)*10)/1e5 as latitude,
  (6900000 + ((user_id*53)%257)*10000 + ((event_id*29)%103-51)*10)/1e5 as longitude,
  value as frp, 290e0 + ((event_id*31)%900)/1e1 as brightness_temperature,
  290e0 + ((event_id*31)%900)/1e1 - ((event_id*13)%400)/1e1 as bright_ti5,
  case event_id%3 when 0 then 30e0 when 1 then 60e0 else 90e0 end as confidence,
  case event_id%3 when 0 then 'l' when 1 then 'n' else 'h' end as conf_code,
  cast(ts as timestamp) as ts,
  case event_type when 'view' then 'N20' when 'signup' then 'N21' when 'purchase' then 'VIIRS'
    when 'click' then 'MODIS_TERRA' else 'MODIS_AQUA' end as satellite
from events"""),
    "fx_raw": (("fx_detection",), """
select event_id*2 as row_no,
  case when event_id%101=0 then '95.0' when event_id%103=0 then '' when event_id%107=0 then 'abc' else cast(latitude as string) end as lat,
  case when event_id%109=0 then '200.0' else cast(longitude as string) end as lon,
  cast(cast(ts as date) as string) as acq_date,
  case when event_id%113=0 then '2561' else cast(hour(ts)*100+minute(ts) as string) end as acq_time,
  case when event_id%127=0 then '' when event_id%131=0 then '-1.5' else cast(frp as string) end as frp,
  case when event_id%5=0 then '' else cast(brightness_temperature as string) end as bright_ti4,
  case when event_id%35=0 then '' else cast(bright_ti5 as string) end as bright_ti5,
  case when event_id%137=0 then 'x' when event_id%2=0 then conf_code else cast(confidence as string) end as conf,
  case satellite when 'MODIS_TERRA' then 'Terra' when 'MODIS_AQUA' then 'aqua' when 'VIIRS' then 'npp' else satellite end as sat
from fx_detection
union all
select event_id*2+1, cast(latitude as string), cast(longitude as string), cast(cast(ts as date) as string),
  cast(hour(ts)*100+minute(ts) as string), cast(frp+1e0 as string), cast(brightness_temperature as string),
  cast(bright_ti5 as string), conf_code,
  case satellite when 'MODIS_TERRA' then 'Terra' when 'MODIS_AQUA' then 'aqua' when 'VIIRS' then 'npp' else satellite end
from fx_detection where event_id%50=0"""),
    "fx_facility": (("customer",), """
select c_custkey as ord, concat('F', cast(c_custkey as string)) as facility_id, c_name as name,
  case c_custkey%10 when 0 then 'refinery' when 1 then 'power_plant' when 2 then 'factory' when 3 then 'industrial_area'
    when 4 then 'oil_gas' when 5 then 'chemical' when 6 then 'steel' when 7 then 'cement' when 8 then 'warehouse' else 'other' end as facility_type,
  (800000 + ((cast(floor(c_custkey/1e1) as bigint)*37)%251)*10000 + ((c_custkey*7)%41-20)*100)/1e5 as lat,
  (6900000 + ((cast(floor(c_custkey/1e1) as bigint)*53)%257)*10000 + ((c_custkey*11)%43-21)*100)/1e5 as lon
from customer"""),
    "fx_tags": (("customer",), """
select c_custkey as ord,
  case c_custkey%9 when 0 then 'refinery' when 1 then 'Steel_Mill' when 2 then 'gas' end as industrial,
  case c_custkey%7 when 0 then 'generator' when 1 then 'plant' when 2 then 'substation' end as power,
  case c_custkey%4 when 0 then 'coal' when 1 then 'wind' end as generator_source,
  case c_custkey%5 when 0 then 'industrial' when 1 then 'forest' end as landuse,
  case c_custkey%6 when 0 then 'storage_tank' when 1 then 'works' when 2 then 'petroleum_well' end as man_made,
  case c_custkey%3 when 0 then 'water' when 1 then 'oil' end as content,
  case c_custkey%8 when 0 then 'warehouse' when 1 then 'industrial' end as building
from customer"""),
    "fx_infra": (("supplier",), """
select s_suppkey as ord, s_name as name,
  case s_suppkey%6 when 0 then 'power_plant' when 1 then 'oil_refinery' when 2 then 'oil_well' when 3 then 'ethanol_plant'
    when 4 then 'wind_farm' else 'solar_plant' end as facility_type,
  (800000 + ((s_suppkey*37)%251)*10000 + ((s_suppkey*7)%41-20)*100)/1e5 as lat,
  (6900000 + ((s_suppkey*53)%257)*10000 + ((s_suppkey*11)%43-21)*100)/1e5 as lon
from supplier"""),
    "fx_flare_year": (("part",), """
select p_partkey as ord, p_brand as country, p_name as field_name, p_type as flare_level,
  2012 + cast((p_partkey*5)%13 as int) as yr, p_retailprice/1e2 as volume,
  (800000 + (((p_partkey%97)*37)%251)*10000 + 300)/1e5 as lat,
  (6900000 + (((p_partkey%97)*53)%257)*10000 - 300)/1e5 as lon
from part"""),
    "fx_landcover": (("nation",), """
select n_nationkey as ord, 69e0+(n_nationkey*7)%25 as x0, 77e0+(n_nationkey*7)%25 as x1, 8e0+n_nationkey as y0, 8.9e0+n_nationkey as y1,
  case n_nationkey%6 when 0 then 'forest' when 1 then 'agriculture' when 2 then 'industrial' when 3 then 'water' when 4 then 'bare' else 'other' end as class
from nation"""),
    "fx_boundary": ((), """
select * from (values (0,72e0,9e0,86e0,9e0),(0,86e0,9e0,93e0,15e0),(0,93e0,15e0,93e0,26e0),(0,93e0,26e0,86e0,32e0),
 (0,86e0,32e0,76e0,32e0),(0,76e0,32e0,70e0,26e0),(0,70e0,26e0,70e0,14e0),(0,70e0,14e0,72e0,9e0),
 (1,79e0,18e0,83e0,18e0),(1,83e0,18e0,83e0,22e0),(1,83e0,22e0,79e0,22e0),(1,79e0,22e0,79e0,18e0)) as t(ring,x1,y1,x2,y2)"""),
    "fx_context": (("events",), """
select event_id, value as frp, 290e0 + ((event_id*31)%900)/1e1 as brightness_temperature,
  case event_id%3 when 0 then 30e0 when 1 then 60e0 else 90e0 end as confidence,
  case when event_id%4=0 then null else ((event_id*97)%8000)/1e0 end as distance_to_facility_m,
  case when event_id%5=0 then null else ((event_id*89)%6000)/1e0 end as distance_to_forest_m,
  case when event_id%6=0 then null else ((event_id*83)%6000)/1e0 end as distance_to_agriculture_m,
  case event_id%8 when 0 then 'refinery' when 1 then 'power_plant' when 2 then 'steel' when 3 then 'warehouse' when 4 then 'gas' when 5 then 'chemical' end as facility_type,
  case when event_id%7=0 then null else ((event_id*11)%101)/1e2 end as persistence_score,
  (event_id*3)%8 as detections_24h, (event_id*3)%8 + (event_id*5)%20 as detections_7d,
  (event_id*3)%8 + (event_id*5)%20 + (event_id*7)%30 as detections_30d,
  1 + (event_id*13)%18 as hotspot_cluster_size,
  case when event_id%9=0 then null else ((event_id*19)%160-60)/1e2 end as ndvi,
  case when event_id%9=1 then null else ((event_id*23)%160-60)/1e2 end as ndbi,
  case when event_id%10=0 then null else ((event_id*7)%40)/1e1 end as facility_baseline,
  case when event_id%11=0 then null else ((event_id*17)%90)/1e1 end as current_activity,
  1 + (event_id*3)%9 as distinct_dates, (event_id*5)%20 as span_days
from events"""),
    "fx_prediction": (("events",), """
select event_id,
  case (event_id*7)%6 when 0 then 'industrial_fire' when 1 then 'persistent_industrial_thermal_source' when 2 then 'gas_flare'
    when 3 then 'wildfire' when 4 then 'agricultural_fire' else 'unknown' end as classification,
  case (event_id*11)%6 when 0 then 'industrial_fire' when 1 then 'persistent_industrial_thermal_source' when 2 then 'gas_flare'
    when 3 then 'wildfire' when 4 then 'agricultural_fire' else 'unknown' end as true_label,
  ((event_id*37)%101)/1e2 as confidence, (event_id*41)%101 as risk_score,
  case when (event_id*41)%101>=75 then 'CRITICAL' when (event_id*41)%101>=50 then 'HIGH' when (event_id*41)%101>=30 then 'MODERATE' else 'LOW' end as risk_level
from events where event_id%10<>9"""),
    "fx_alert_action": (("events",), """
select user_id as alert_id, event_id as seq, cast(ts as timestamp) as at,
  case event_type when 'click' then 'ACKNOWLEDGE' when 'purchase' then 'ESCALATE' else 'RESOLVE' end as action,
  case when event_id%4=0 then null else event_id%4 end as caller_tier
from events where event_type in ('click','purchase','signup') and (event_type<>'signup' or event_id%6=0)"""),
    "fx_landed": (("events",), """
select distinct case event_type when 'view' then 'N20' when 'signup' then 'N21' else 'VIIRS' end as source, cast(ts as date) as chunk_date
from events where event_type in ('view','signup','purchase') and (extract(day from ts)*7+length(event_type))%5<>0"""),
    # Views below are this project's own, in the same style: inputs the tables above do not cover.
    "fx_tracker": (("events",), """
select event_id, value as frp, ((event_id*13)%400)/1e1 as temp_diff_ti4_ti5, cast(event_id%2 as int) as is_night,
  ((event_id*29)%301)/1e1 as distance_to_plant_km, ((event_id*23)%297)/1e1 as distance_to_flare_km,
  ((event_id*19)%293)/1e1 as distance_to_coal_mine_km,
  least(((event_id*29)%301)/1e1, ((event_id*23)%297)/1e1, ((event_id*19)%293)/1e1) as min_distance_to_industrial_km,
  1 + event_id%7 as spatial_persistence_count,
  case event_id%4 when 0 then 'gas' when 1 then 'coal' when 2 then 'oil' end as nearest_plant_fuel,
  concat('P', cast(event_id%50 as string)) as nearest_plant_name, concat('B', cast(event_id%40 as string)) as nearest_flare_field,
  case when event_id%13=0 then null else ((event_id*37)%101)/1e2 end as prob_industrial,
  case event_id%3 when 0 then 'high' when 1 then 'nominal' else 'low' end as confidence
from events"""),
    "fx_alert_info": (("events",), """
select user_id as alert_id, case user_id%5 when 0 then 'Gujarat' when 1 then 'Odisha' when 2 then 'Maharashtra' when 3 then 'Assam' else 'Chhattisgarh' end as region,
  case user_id%4 when 0 then 'critical' when 1 then 'high' when 2 then 'moderate' else 'low' end as severity, max(value) as frp
from events group by user_id"""),
    "fx_user": (("nation",), """
select n_nationkey as user_id, case when n_nationkey%6=0 then 'Central Government' else 'State' end as role,
  case n_nationkey%5 when 0 then 'Gujarat' when 1 then 'Odisha' when 2 then 'Maharashtra' when 3 then 'Assam' else 'Chhattisgarh' end as region
from nation"""),
    "fx_landcover_edge": (("fx_landcover",), """
select ord, cast(ord as string) as geom_id, 0 as poly, 0 as ring, x0 as x1, y0 as y1, x1 as x2, y0 as y2 from fx_landcover
union all select ord, cast(ord as string), 0, 0, x1, y0, x1, y1 from fx_landcover
union all select ord, cast(ord as string), 0, 0, x1, y1, x0, y1 from fx_landcover
union all select ord, cast(ord as string), 0, 0, x0, y1, x0, y0 from fx_landcover"""),
    "fx_event_facility": (("fx_detection",), """
select event_id, id, latitude, longitude, frp, brightness_temperature, ts, satellite,
  concat('F', cast(site*10 + event_id%12 as string)) as facility_id, concat('near ', cast(site as string)) as nearest_facility_name,
  'petrochemical' as facility_type, ((event_id*97)%8000)/1e0 as distance_to_facility_m, (event_id*3)%8 as detections_24h,
  (event_id*3)%8 + (event_id*5)%20 as detections_7d, ((event_id*11)%101)/1e2 as persistence_score
from fx_detection"""),
    "fx_plant": (("customer",), """
select c_custkey as ord, c_name as name, c_mktsegment as fuel, case when c_custkey%7=0 then 'n/a' else cast(c_acctbal as string) end as capacity,
  case c_custkey%3 when 0 then 'operating' when 1 then 'construction' end as status,
  case when c_custkey%11=0 then '' else cast((800000 + ((cast(floor(c_custkey/1e1) as bigint)*37)%251)*10000 + ((c_custkey*13)%41-20)*100)/1e5 as string) end as lat,
  cast((6900000 + ((cast(floor(c_custkey/1e1) as bigint)*53)%257)*10000 + ((c_custkey*17)%43-21)*100)/1e5 as string) as lon
from customer"""),
    "fx_mine": (("supplier",), """
select s_suppkey as ord, concat('M', cast(s_suppkey as string)) as mine_id, s_name as name,
  case s_suppkey%3 when 0 then 'operating' when 1 then 'proposed' end as status, case s_suppkey%2 when 0 then 'surface' else 'underground' end as mine_type,
  cast((800000 + ((s_suppkey*37)%251)*10000 + ((s_suppkey*7)%41-20)*100)/1e5 as string) as lat,
  cast((6900000 + ((s_suppkey*53)%257)*10000 + ((s_suppkey*11)%43-21)*100)/1e5 as string) as lon
from supplier"""),
    "fx_ring": (("nation",), """
select n_nationkey as ord, 69e0+(n_nationkey*7)%25 as x0, 8e0+n_nationkey as y0, 1e0+(n_nationkey%3) as side from nation"""),
    "fx_props": (("customer",), """
select c_custkey as ord,
  case c_custkey%7 when 0 then 'Dense Forest' when 1 then 'Farmland' when 2 then 'built-up' when 3 then 'lake' end as class,
  case c_custkey%5 when 0 then 'sandstone' when 1 then 'unknown' when 2 then 'industrial' when 3 then '' end as landuse,
  case c_custkey%4 when 0 then 'grassland' when 1 then 'rock' end as natural_kind
from customer"""),
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame over the parquet tables."""
    uses, text = VIEWS[name]
    inputs = {u: view(spark, sf_dir, u) if u in VIEWS else table(spark, sf_dir, u) for u in uses}
    for u in uses:
        text = text.replace(f"from {u}", "from {%s}" % u)
    return spark.sql(text, **inputs) if inputs else spark.sql(text)


def with_views(sql: str, *names: str) -> str:
    """Prefix a check query with the fixture views it needs (and those they build on)."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for u in VIEWS[name][0]:
                add(u)
            ordered.append(name)

    for name in names:
        add(name)
    heads = ",\n".join(f"{n} as ({VIEWS[n][1].strip()})" for n in ordered)
    if not heads:
        return sql
    sql = sql.strip()
    if sql.lower().startswith("with recursive "):
        return f"with recursive {heads},\n{sql[len('with recursive '):]}"
    if sql.lower().startswith("with "):
        return f"with {heads},\n{sql[5:]}"
    return f"with {heads}\n{sql}"
