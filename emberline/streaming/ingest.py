"""Incremental ingest of landed detection files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators import clean
from emberline.operators.proximity import nearest_within

# Headers of a standard detection export.
RAW_COLUMNS = ["latitude", "longitude", "bright_ti4", "bright_ti5", "scan", "track", "acq_date", "acq_time", "satellite",
               "instrument", "confidence", "version", "bright_t31", "frp", "daynight"]


def stream_detections(spark: SparkSession, directory: str, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """New CSV files under the landing directory, each read once, as raw string columns."""
    return (spark.readStream.schema(", ".join(f"`{c}` string" for c in columns)).option("header", "true")
            .option("recursiveFileLookup", "true").csv(directory)
            .withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.lit(0).cast("long")))


def dedup_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming dedup on (satellite, minute, 4-decimal cell); state is dropped behind the watermark."""
    keyed = events.withColumns({"_minute": F.date_trunc("minute", "ts"), "_la": F.bround("latitude", 4),
                                "_lo": F.bround("longitude", 4)})
    return (keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["satellite", "_minute", "_la", "_lo"])
            .drop("_minute", "_la", "_lo"))


def ingest(spark: SparkSession, directory: str, out: str, checkpoint: str, columns: list[str] = RAW_COLUMNS,
           rejects: str | None = None) -> StreamingQuery:
    """Clean what has landed since the last run and append it, partitioned by date; returns the started query.

    Each batch is parsed once and has its own folders: valid rows under ``out``,
    the others with their reason and raw fields under ``rejects`` (``out`` with
    ``_rejects`` appended, if not given).  A replayed batch overwrites its own folders.
    """
    bad = rejects or f"{out.rstrip('/')}_rejects"

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            valid, rejected = clean.split_checked(batch)
            valid.write.mode("overwrite").partitionBy("acq_date").parquet(f"{out}/batch={batch_id}")
            rejected.write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        finally:
            batch.unpersist()
    return each_batch(clean.validated(stream_detections(spark, directory, columns)), checkpoint, step)


def each_batch(events: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a batch operator on every micro-batch."""
    return (events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def enrich_stream(events: DataFrame, facilities: DataFrame, out: str, checkpoint: str, radius_m: float = 5000.0) -> StreamingQuery:
    """Append every micro-batch with its nearest facility; a replayed batch overwrites its own folder."""
    def step(batch: DataFrame, batch_id: int) -> None:
        nearest_within(batch, facilities, radius_m).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return each_batch(events, checkpoint, step)


def persistence_stream(events: DataFrame, history: str, out: str, checkpoint: str) -> StreamingQuery:
    """Persistence of each micro-batch against the history table plus the batch, which is then appended to it.

    Batches are written to their own folders, so a retried batch replaces its
    earlier attempt; a batch reads the folders of earlier batches only.
    """
    from emberline.operators.enrichment import persistence

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(history)
        if "batch" in known.columns:
            known = known.filter(F.col("batch") < batch_id)
        # Only the last 30 days before the batch can count; the filter reaches the Parquet statistics.
        oldest = batch.agg(F.min("ts").alias("t")).first()["t"]
        if oldest is None:
            return
        known = known.filter(F.col("ts") >= F.lit(oldest) - F.expr("interval 30 days"))
        seen = known.select("id", "latitude", "longitude", "ts").unionByName(batch.select("id", "latitude", "longitude", "ts"))
        persistence(batch, seen).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        batch.select("id", "latitude", "longitude", "ts").write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
    return each_batch(events, checkpoint, step)
