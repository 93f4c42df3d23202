"""Queries over cleaning, typing and projections."""

from pyspark.sql import functions as F

from emberline.fixtures import view
from emberline.functions import cleaning as K
from emberline.functions import timefeat, typing_rules
from emberline.operators import clean
from emberline.operators.features import engineer
from emberline.plans.registry import query

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def raw_feed(spark, sf):
    return view(spark, sf, "fx_raw").withColumnRenamed("row_no", "_row").withColumn("_file", F.lit("feed"))


# Independent statement of the row checks, shared by several checks below.
CHECKED = """
parsed as (
  select row_no, lat, lon, acq_date, acq_time, frp as frp_raw, conf,
    try_cast(nullif(trim(lat),'') as double) as lat_v, try_cast(nullif(trim(lon),'') as double) as lon_v,
    try_cast(nullif(trim(frp),'') as double) as frp_v,
    coalesce(try_cast(nullif(trim(bright_ti4),'') as double), try_cast(nullif(trim(bright_ti5),'') as double)) as bt,
    case when nullif(trim(bright_ti4),'') is not null then 'bright_ti4' when nullif(trim(bright_ti5),'') is not null then 'bright_ti5' end as bt_source,
    case lower(trim(conf)) when 'l' then 30e0 when 'n' then 60e0 when 'h' then 90e0 else try_cast(nullif(trim(conf),'') as double) end as conf_v,
    lpad(acq_time, 4, '0') as hhmm,
    case when lower(sat) in ('terra','aqua') then concat('MODIS_', upper(sat)) when lower(sat) in ('viirs','v','n','j1','npp') then 'VIIRS' else upper(sat) end as satellite
  from fx_raw),
timed as (
  select *, case when cast(hhmm[1:2] as int) <= 23 and cast(hhmm[3:4] as int) <= 59
     then cast(acq_date as timestamp) + to_hours(cast(hhmm[1:2] as int)) + to_minutes(cast(hhmm[3:4] as int)) end as ts
  from parsed),
checked as (
  select *, case
    when trim(lat)='' then 'missing latitude' when lat_v is null then concat('malformed latitude: ''', lat, '''')
    when lat_v < -90 or lat_v > 90 then concat('latitude out of range: ', cast(lat_v as varchar))
    when trim(lon)='' then 'missing longitude' when lon_v is null then concat('malformed longitude: ''', lon, '''')
    when lon_v < -180 or lon_v > 180 then concat('longitude out of range: ', cast(lon_v as varchar))
    when ts is null then concat('acq_time out of range: ''', acq_time, '''')
    when trim(frp_raw)='' then 'missing frp' when frp_v < 0 then concat('negative frp: ', cast(frp_v as varchar))
    when bt is null then 'missing brightness_temperature (no bright_ti4/ti5/t31)'
    when bt < 0 then 'invalid brightness_temperature' when bt < 100 or bt > 1000 then 'brightness_temperature out of plausible range'
    when trim(conf)='' then 'missing confidence' when conf_v is null then concat('malformed confidence: ''', conf, '''')
    when conf_v < 0 or conf_v > 100 then concat('confidence out of range 0-100: ''', conf, '''') end as reason
  from timed)"""
IDS = """concat('FIRMS_', upper(substr(sha1(concat(satellite, '|', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '|', printf('%.5f', lat_v), '|', printf('%.5f', lon_v))), 1, 8)))"""
FIRST = "row_number() over (partition by satellite, date_trunc('minute', ts), round_even(lat_v, 4), round_even(lon_v, 4) order by row_no) = 1"


@query("clean_events", f"""with {CHECKED}
select row_no, lat_v as latitude, lon_v as longitude, frp_v as frp, bt as brightness_temperature, conf_v as confidence,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, satellite, bt_source, {IDS} as id from checked where reason is null""", "fx_raw")
def clean_events(spark, sf):
    valid, _ = clean.clean_events(raw_feed(spark, sf))
    return valid.select(F.col("_row").alias("row_no"), "latitude", "longitude", "frp", "brightness_temperature",
                        "confidence", F.date_format("ts", ISO).alias("timestamp"), "satellite", "bt_source", "id")


@query("reject_reasons", f"with {CHECKED} select row_no, reason from checked where reason is not null", "fx_raw")
def reject_reasons(spark, sf):
    _, rejects = clean.clean_events(raw_feed(spark, sf))
    return rejects.select(F.col("_row").alias("row_no"), "reason")


@query("det_id", f"with {CHECKED} select row_no, {IDS} as id from checked where reason is null", "fx_raw")
def det_id(spark, sf):
    valid, _ = clean.clean_events(raw_feed(spark, sf))
    return valid.select(F.col("_row").alias("row_no"), "id")


@query("dedup", f"""with {CHECKED} select row_no, {IDS} as id, frp_v as frp from checked where reason is null qualify {FIRST}""", "fx_raw")
def dedup(spark, sf):
    valid, _ = clean.clean_events(raw_feed(spark, sf))
    return clean.dedup(valid).select(F.col("_row").alias("row_no"), "id", "frp")


@query("quality_report", f"""with {CHECKED},
uniq as (select * from checked where reason is null qualify {FIRST}),
tot as (select count(*) n, count(*) filter (reason is null) ok, count(*) filter (reason is not null) bad, count(*) filter (reason='missing frp') mf,
  count(*) filter (reason='missing confidence') mc, count(*) filter (reason like 'missing brightness%') mb from checked),
kept as (select count(*) n, count(distinct satellite) s, min(ts) t0, max(ts) t1, min(lat_v) a, max(lat_v) b, min(lon_v) c, max(lon_v) d from uniq)
select 'input_rows' as metric, '' as key, cast(n as varchar) as value from tot union all select 'invalid_rows', '', cast(bad as varchar) from tot
union all select 'missing_frp', '', cast(mf as varchar) from tot union all select 'missing_confidence', '', cast(mc as varchar) from tot
union all select 'missing_bt', '', cast(mb as varchar) from tot union all select 'valid_rows', '', cast(n as varchar) from kept
union all select 'unique_satellites', '', cast(s as varchar) from kept
union all select 'date_min', '', strftime(t0, '%Y-%m-%dT%H:%M:%SZ') from kept union all select 'date_max', '', strftime(t1, '%Y-%m-%dT%H:%M:%SZ') from kept
union all select 'lat_min', '', cast(a as varchar) from kept union all select 'lat_max', '', cast(b as varchar) from kept
union all select 'lon_min', '', cast(c as varchar) from kept union all select 'lon_max', '', cast(d as varchar) from kept
union all select 'duplicates_removed', '', cast(tot.ok - kept.n as varchar) from tot, kept
union all select 'satellite', satellite, cast(count(*) as varchar) from uniq group by satellite
union all select 'invalid_reason', split_part(reason, ':', 1), cast(count(*) as varchar) from checked where reason is not null group by 2""", "fx_raw")
def quality_report(spark, sf):
    return clean.quality_report(raw_feed(spark, sf))


@query("alias_columns", "select row_no, lat as latitude, lon as longitude, acq_date, conf as confidence, sat as satellite from fx_raw", "fx_raw")
def alias_columns(spark, sf):
    return K.alias_columns(view(spark, sf, "fx_raw")).select("row_no", "latitude", "longitude", "acq_date", "confidence", "satellite")


@query("confidence_norm", """select row_no, case conf when 'l' then 30e0 when 'n' then 60e0 when 'h' then 90e0 when 'x' then null else cast(conf as double) end as confidence,
  case when conf = 'x' then 'malformed confidence: ''x''' end as reason from fx_raw""", "fx_raw")
def confidence_norm(spark, sf):
    value, reason = K.confidence_percent(F.col("conf"))
    return view(spark, sf, "fx_raw").select("row_no", value.alias("confidence"), reason.alias("reason"))


@query("confidence_unit", """select row_no, case conf when 'l' then 0.33e0 when 'n' then 0.66e0 when 'h' then 1e0 else 0.5e0 end as confidence_numeric from fx_raw""", "fx_raw")
def confidence_unit(spark, sf):
    return view(spark, sf, "fx_raw").select("row_no", K.confidence_unit(F.col("conf")).alias("confidence_numeric"))


@query("parse_ts", """select row_no, case when acq_time='2561' then null else strftime(cast(acq_date as timestamp) + to_minutes(cast(floor(cast(acq_time as int)/1e2) as int)*60 + cast(acq_time as int)%100), '%Y-%m-%dT%H:%M:%SZ') end as timestamp,
  case when acq_time='2561' then 'acq_time out of range: ''2561''' end as reason from fx_raw""", "fx_raw")
def parse_ts(spark, sf):
    raw = view(spark, sf, "fx_raw")
    ts, reason = K.acquisition_time(raw.columns)
    return raw.select("row_no", F.date_format(ts, ISO).alias("timestamp"), reason.alias("reason"))


@query("bt_priority", """select row_no, case when bright_ti4<>'' then cast(bright_ti4 as double) when bright_ti5<>'' then cast(bright_ti5 as double) end as bt,
  case when bright_ti4<>'' then 'bright_ti4' when bright_ti5<>'' then 'bright_ti5' end as bt_source from fx_raw""", "fx_raw")
def bt_priority(spark, sf):
    raw = view(spark, sf, "fx_raw")
    value, source = K.brightness(raw.columns)
    return raw.select("row_no", value.alias("bt"), source.alias("bt_source"))


@query("satellite_canon", """select row_no, case sat when 'Terra' then 'MODIS_TERRA' when 'aqua' then 'MODIS_AQUA' when 'npp' then 'VIIRS' else sat end as satellite from fx_raw""", "fx_raw")
def satellite_canon(spark, sf):
    raw = K.alias_columns(view(spark, sf, "fx_raw"))
    return raw.select("row_no", K.satellite_name(raw.columns).alias("satellite"))


@query("dedup_facility", """with tiles as (select facility_id, ord, name from fx_facility union all select facility_id, ord + 1000000, concat(name, ' copy') from fx_facility
  union all select facility_id, ord + 2000000, concat(name, ' copy 2') from fx_facility)
select facility_id, ord, name from tiles qualify row_number() over (partition by facility_id order by ord) = 1""", "fx_facility")
def dedup_facility(spark, sf):
    fac = view(spark, sf, "fx_facility").select("facility_id", "ord", "name")
    tiles = fac
    for shift, tail in ((1000000, " copy"), (2000000, " copy 2")):
        tiles = tiles.unionByName(fac.select("facility_id", (F.col("ord") + shift).alias("ord"), F.concat("name", F.lit(tail)).alias("name")))
    return clean.dedup_facilities(tiles)


@query("bbox_filter", """select event_id, latitude, longitude from fx_detection where latitude between 6e0 and 37.5e0 and longitude between 68e0 and 80e0""", "fx_detection")
def bbox_filter(spark, sf):
    return clean.bbox_filter(view(spark, sf, "fx_detection"), 6.0, 68.0, 37.5, 80.0).select("event_id", "latitude", "longitude")


@query("buffered_bbox", """with box as (select greatest(-90e0, min(latitude)-2e0) s, least(90e0, max(latitude)+2e0) n, greatest(-180e0, min(longitude)-2e0) w, least(180e0, max(longitude)+2e0) e from fx_detection)
select facility_id, lat, lon from fx_facility, box where lat between s and n and lon between w and e""", "fx_detection fx_facility")
def buffered_bbox(spark, sf):
    box = clean.buffered_extent(view(spark, sf, "fx_detection"))
    return clean.within_extent(view(spark, sf, "fx_facility"), box).select("facility_id", "lat", "lon")


def tag_table(spark, sf):
    """Tag columns as a map without the absent tags."""
    raw = view(spark, sf, "fx_tags")
    names = {"industrial": "industrial", "power": "power", "generator_source": "generator:source", "landuse": "landuse",
             "man_made": "man_made", "content": "content", "building": "building"}
    pairs = [x for c, tag in names.items() for x in (F.lit(tag), F.col(c))]
    return raw.select("ord", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("tags"))


@query("tag_filter", """select ord from fx_tags where coalesce(power,'')<>'generator' and (industrial is not null or coalesce(landuse,'')='industrial' or coalesce(building,'')='industrial'
  or coalesce(man_made,'') in ('works','petroleum_well','storage_tank') or coalesce(power,'') in ('plant','substation'))""", "fx_tags")
def tag_filter(spark, sf):
    return tag_table(spark, sf).filter(typing_rules.is_relevant(F.col("tags"))).select("ord")


@query("facility_type", """select ord, case
  when industrial='refinery' then 'refinery' when industrial='gas' then 'oil_gas' when industrial='Steel_Mill' then 'steel'
  when power='generator' then case when generator_source='coal' then 'power_plant' else 'other' end
  when power='plant' then 'power_plant'
  when landuse='industrial' then 'industrial_area'
  when man_made='storage_tank' then case when content='oil' then 'oil_gas' else 'other' end
  when man_made='works' then 'factory'
  when building='warehouse' then 'warehouse' when building='industrial' then 'factory'
  else 'other' end as facility_type,
 case when industrial is not null then lower(industrial) when power in ('generator','plant') then power when landuse='industrial' then landuse
  when man_made in ('storage_tank','works') then man_made when building is not null then building else coalesce(landuse, man_made) end as original_type from fx_tags""", "fx_tags")
def facility_type(spark, sf):
    return tag_table(spark, sf).withColumn("t", typing_rules.facility_type(F.col("tags"))).select("ord", "t.*")


@query("landcover_class", """select ord, case class when 'Dense Forest' then 'forest' when 'Farmland' then 'agriculture' when 'built-up' then 'industrial' when 'lake' then 'water'
  else case landuse when 'sandstone' then 'bare' when 'unknown' then 'unknown' when 'industrial' then 'industrial'
  else case natural_kind when 'grassland' then 'other' when 'rock' then 'other' else 'unknown' end end end as landcover_class from fx_props""", "fx_props")
def landcover_class(spark, sf):
    raw = view(spark, sf, "fx_props")
    props = F.create_map(F.lit("class"), F.col("class"), F.lit("landuse"), F.col("landuse"), F.lit("natural"), F.col("natural_kind"))
    return raw.select("ord", typing_rules.landcover_class(props).alias("landcover_class"))


@query("radiometric", """select event_id, round(brightness_temperature - bright_ti5, 6) as temp_diff_ti4_ti5, round(ln(1e0+greatest(0e0, frp)), 6) as log_frp,
  case when hour(ts) between 6 and 18 then 0 else 1 end as is_night, hour(ts) as acq_hour from fx_detection""", "fx_detection")
def radiometric(spark, sf):
    det = view(spark, sf, "fx_detection")
    raw = det.select("event_id", F.col("brightness_temperature").alias("bright_ti4"), "bright_ti5", "frp",
                     F.col("conf_code").alias("confidence"), timefeat.daynight_from_hour(F.hour("ts")).alias("daynight"),
                     (F.hour("ts") * 100 + F.minute("ts")).alias("acq_time"))
    out = timefeat.radiometric(raw)
    return out.select("event_id", F.round("temp_diff_ti4_ti5", 6).alias("temp_diff_ti4_ti5"), F.round("log_frp", 6).alias("log_frp"),
                      "is_night", F.col("acq_hour").cast("long").alias("acq_hour"))


@query("time_features", """select event_id, hour(ts) as hour_utc, isodow(ts)-1 as day_of_week, month(ts) as month, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%Y-%m') as year_month from fx_detection""", "fx_detection")
def time_features(spark, sf):
    out = timefeat.time_features(view(spark, sf, "fx_detection"))
    return out.select("event_id", F.col("hour_utc").cast("long").alias("hour_utc"), F.col("day_of_week").cast("long").alias("day_of_week"),
                      F.col("month").cast("long").alias("month"), F.col("date").cast("string").alias("date"), "year_month")


@query("daynight", """with rec as (select id, case event_id%4 when 0 then 'd' when 1 then 'N' when 2 then '' end as dn from fx_detection)
select d.event_id, case when upper(trim(dn)) in ('D','N') then upper(trim(dn)) when hour(d.ts) between 6 and 18 then 'D' else 'N' end as daynight
from fx_detection d left join rec using (id)""", "fx_detection")
def daynight(spark, sf):
    det = view(spark, sf, "fx_detection")
    k = F.col("event_id") % 4
    late = det.select("id", F.when(k == 0, "d").when(k == 1, "N").when(k == 2, "").alias("daynight"), F.lit(2).alias("_row"))
    early = det.select("id", F.lit("D").alias("daynight"), F.lit(1).alias("_row"))
    return timefeat.daynight(det, early.unionByName(late)).select("event_id", "daynight")


@query("feature_engineer", """select event_id, least(frp/250e0, 1e0) as frp_norm, round(greatest(0e0, least((brightness_temperature-300)/120e0, 1e0)), 9) as bt_norm,
  case when facility_baseline is null or current_activity is null then null when facility_baseline > 0 then round((current_activity-facility_baseline)/facility_baseline, 6) else current_activity end as activity_anomaly,
  case when facility_baseline > 0 then round(current_activity/facility_baseline, 6) end as anomaly_ratio,
  cast(coalesce(facility_type in ('refinery','gas'), false) as int) as is_flare, cast(coalesce(facility_type in ('refinery','power_plant','steel','gas','chemical'), false) as int) as is_industrial,
  cast(distance_to_facility_m is not null or facility_type is not null as int) as has_industrial, cast(distance_to_forest_m is not null as int) as has_forest,
  cast(distance_to_agriculture_m is not null as int) as has_agri, 1 as has_temporal, cast(ndvi is not null or ndbi is not null as int) as has_landcover,
  cast(facility_baseline is not null and current_activity is not null as int) as has_anomaly from fx_context""", "fx_context")
def feature_engineer(spark, sf):
    out = engineer(view(spark, sf, "fx_context"))

    def flag(c, name):
        return F.col(c).cast("int").alias(name)

    return out.select(
        "event_id", "frp_norm", F.round("bt_norm", 9).alias("bt_norm"), F.round("activity_anomaly", 6).alias("activity_anomaly"),
        F.round("anomaly_ratio", 6).alias("anomaly_ratio"), flag("is_flare_facility", "is_flare"),
        flag("is_industrial_facility", "is_industrial"), flag("has_industrial_context", "has_industrial"),
        flag("has_forest_context", "has_forest"), flag("has_agri_context", "has_agri"), flag("has_temporal_context", "has_temporal"),
        flag("has_landcover_context", "has_landcover"), flag("has_anomaly_context", "has_anomaly"))
