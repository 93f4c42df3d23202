"""Stream queries: the files of the scale factor are replayed to the end and compared with the batch result."""

import uuid

from pyspark.sql import functions as F

from emberline.fixtures import VIEWS
from emberline.plans.queries_alerts import FOLD
from emberline.plans.registry import query
from emberline.session import checkpoint_dir
from emberline.streaming import alerts, ingest, windows

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, sf, name):
    """A fixture view over the events file as a stream."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    return spark.sql(VIEWS[name][1].replace("from events", "from {events}"), events=raw)


def replay(spark, df, mode="append"):
    """Run a stream over all available input into a table folder and read it back."""
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", f"{root}/out")
        done = writer.option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/out")

    def step(batch, batch_id):
        # Update mode: the latest batch holds the current value of every changed key.
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/part={batch_id}")

    df.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/state").outputMode("update").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("part")


def latest(df, keys):
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, "_batch").alias("r")).select(*keys, "r.*").drop("_batch")


CELL = "cast(floor(latitude/0.5e0) as bigint) as cell_y, cast(floor(longitude/0.5e0) as bigint) as cell_x"


@query("stream_dedup", "select satellite, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') as minute, round_even(latitude,4) as lat, round_even(longitude,4) as lon from fx_detection group by 1, 2, 3, 4", "fx_detection")
def stream_dedup(spark, sf):
    out = replay(spark, ingest.dedup_stream(event_stream(spark, sf, "fx_detection")))
    return out.select("satellite", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.bround("latitude", 4).alias("lat"),
                      F.bround("longitude", 4).alias("lon"))


@query("stream_daily", f"select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, {CELL}, count(*) as detections, round(sum(frp), 4) as frp_sum from fx_detection group by 1, 2, 3", "fx_detection")
def stream_daily(spark, sf):
    out = replay(spark, windows.daily_activity(event_stream(spark, sf, "fx_detection")), "update")
    out = latest(out, ["window_start", "cell_y", "cell_x"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "cell_y", "cell_x", "detections",
                      F.round("frp_sum", 4).alias("frp_sum"))


@query("stream_weekly", f"""select strftime(cast(ts as date) - o, '%Y-%m-%d') as start_day, {CELL}, count(*) as detections, round(sum(frp), 4) as frp_sum from fx_detection, (values (0),(1),(2),(3),(4),(5),(6)) v(o) group by 1, 2, 3""", "fx_detection")
def stream_weekly(spark, sf):
    out = replay(spark, windows.weekly_activity(event_stream(spark, sf, "fx_detection")), "update")
    out = latest(out, ["window_start", "cell_y", "cell_x"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("start_day"), "cell_y", "cell_x", "detections",
                      F.round("frp_sum", 4).alias("frp_sum"))


@query("stream_alerts", f"with {FOLD} select alert_id, seq, action, cast(accepted as int) as accepted, tier as from_tier, tier + cast(accepted and action='ESCALATE' as int) as to_tier from marked", "fx_alert_action fx_alert_info")
def stream_alerts(spark, sf):
    out = replay(spark, alerts.stream_alerts(event_stream(spark, sf, "fx_alert_action")))
    return out.select("alert_id", "seq", "action", F.col("accepted").cast("int").alias("accepted"), "from_tier", "to_tier")


@query("stream_ingest")
def stream_ingest(spark, sf):
    """The raw feed is landed as CSV files, ingested once, and ingested again (nothing new may appear): rows and rejects per date."""
    from emberline.plans.queries_clean import raw_feed
    root = f"{checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    raw = raw_feed(spark, sf).drop("_file", "_row")
    raw.write.option("header", "true").csv(f"{root}/raw")
    for _ in range(2):
        ingest.ingest(spark, f"{root}/raw", f"{root}/clean", f"{root}/state", raw.columns, f"{root}/rejects").awaitTermination()
    valid = spark.read.parquet(f"{root}/clean").groupBy("acq_date").agg(F.count(F.lit(1)).alias("rows"))
    # A reject may have no date that can be read: its own, as it was landed.
    bad = spark.read.parquet(f"{root}/rejects").groupBy(F.col("raw")["acq_date"].alias("landed_date"), "reason").agg(
        F.count(F.lit(1)).alias("rows"))
    return valid.select(F.lit("valid").alias("outcome"), F.col("acq_date").cast("string").alias("acq_date"),
                        F.lit(None).cast("string").alias("reason"), "rows").unionByName(
        bad.select(F.lit("reject").alias("outcome"), F.col("landed_date").alias("acq_date"), "reason", "rows"))
