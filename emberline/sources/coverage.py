"""Planning and coverage of landed ingest chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_calendar(spans: DataFrame, max_days: int = 5) -> DataFrame:
    """(source, chunk_start, chunk_end, days) for inclusive date ranges cut into pieces of at most ``max_days``.

    ``spans``: source, start, end.
    """
    starts = F.sequence("start", "end", F.expr(f"interval {int(max_days)} day"))
    out = spans.select("source", "end", F.explode(starts).alias("chunk_start"))
    out = out.withColumn("chunk_end", F.least(F.date_add("chunk_start", max_days - 1), F.col("end")))
    return out.select("source", "chunk_start", "chunk_end", (F.datediff("chunk_end", "chunk_start") + 1).alias("days"))


def landing_coverage(calendar: DataFrame, landed: DataFrame, max_days: int = 5) -> DataFrame:
    """Per calendar chunk: landed records and status (ok, empty, missing).

    ``landed``: source, chunk_start, records (one row per landed file; 0 records is an empty file).
    """
    files = landed.groupBy("source", "chunk_start").agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("files"))
    out = calendar.join(files, ["source", "chunk_start"], "left")
    status = F.when(F.col("files").isNull(), "missing").when(F.col("records") > 0, "ok").otherwise("empty")
    return out.select("source", "chunk_start", "chunk_end", "days",
                      F.coalesce("records", F.lit(0)).cast("long").alias("records"), status.alias("status"))


def missing_chunks(calendar: DataFrame, landed: DataFrame) -> DataFrame:
    return calendar.join(landed.select("source", "chunk_start"), ["source", "chunk_start"], "left_anti")
