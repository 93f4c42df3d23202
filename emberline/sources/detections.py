"""Detection CSV scans and event lists."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.cleaning import SchemaError, require_columns, to_double
from emberline.sources.detection_csv import RANGE_BYTES, DetectionCsv, read_head
from emberline.sources.files import landed, open_store


def read_detections(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None,
                    range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Raw detections as canonical string columns plus ``_file`` and ``_row`` (the byte at which the line begins: file order).

    Each file's header line gives its columns and its delimiter (``;`` only when it has no comma);
    files with other headers merge by name.  Values are trimmed, blanks are NULL, all-blank rows are
    dropped.  Raises on an empty or header-only input and on missing column groups.
    """
    out = _scan(spark, path, recursive, pattern, range_bytes)
    if out.limit(1).isEmpty():
        raise SchemaError(f"header but no data rows: {path}")
    return out


def _scan(spark: SparkSession, path: str, recursive: bool, pattern: str | None, range_bytes: int) -> DataFrame:
    """One scan over all files; only their first bytes are read here."""
    files = landed(path, recursive, pattern)
    store, _, _ = open_store(path.rstrip("*"))
    with ThreadPoolExecutor(32) as pool:
        heads = [h for h in pool.map(lambda f: read_head(store, f.path), files) if h is not None]
    if not heads:
        raise SchemaError(f"input is empty: {path}")
    kinds = list(dict.fromkeys(tuple(h.columns) for h in heads))
    for columns in kinds:
        require_columns(list(columns))
    wanted = list(dict.fromkeys(c for columns in kinds for c in columns))
    schema = ", ".join([*[f"`{c.replace('`', '``')}` string" for c in wanted], "_file string", "_row bigint"])
    spark.dataSource.register(DetectionCsv)
    reader = spark.read.format(DetectionCsv.name()).schema(schema).option("rangeBytes", range_bytes).option("recursive", str(recursive).lower())
    return (reader.option("pattern", pattern) if pattern else reader).load(path)


def read_chunks(spark: SparkSession, directory: str, pattern: str = "*.csv", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All chunk files under a directory as one table; ``source`` is the folder of the file.

    One scan over all of them; files with different headers merge by name.
    """
    if not landed(directory, True, pattern):
        raise FileNotFoundError(f"no {pattern} under {directory}")
    out = read_detections(spark, directory, True, pattern, range_bytes)
    return out.withColumn("source", F.regexp_extract("_file", "([^/]+)/[^/]+$", 1))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event list from JSON (array or lines) or CSV, numbers coerced where they parse."""
    numeric = ["latitude", "longitude", "frp", "brightness_temperature", "confidence"]
    if path.rstrip("/").lower().endswith((".csv", ".txt")):
        df = spark.read.option("header", "true").csv(path)
    else:
        # Spark's own inference over multi-line files copies the list of all files for each file; from texts it is one scan.
        texts = spark.read.text(path, wholetext=True).select("value").rdd.map(lambda row: row[0])
        schema = spark.read.option("primitivesAsString", "true").json(texts).schema
        reader = spark.read.option("multiLine", "true").option("primitivesAsString", "true")
        # Other encodings than UTF-8 are left to Spark.
        df = (reader if "_corrupt_record" in schema.names else reader.schema(schema)).json(path)
    return df.withColumns({c: to_double(F.col(c).cast("string")) for c in numeric if c in df.columns})


def tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """Event, facility, prediction and alert tables of a warehouse directory."""
    return {name: spark.read.parquet(f"{directory}/{name}") for name in ("event", "facility", "prediction", "alert")}
