"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage reads what its predecessor kept, as stored Parquet, and returns the
columns of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import mixture, neardup, packing, paragraphs, quality
from emberline.llm.common import is_scan, land, small_batches


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that fail the base rules or lie far from every language reference go."""
    small_batches(spark)
    return quality.judge(docs).filter("kept").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group linked by fingerprints, or by similarity (five-word shingles, Jaccard 0.8), stays."""
    small_batches(spark)
    return neardup.deduplicate(docs, stored=is_scan(docs))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated paragraphs go from all documents but the first."""
    small_batches(spark)
    return paragraphs.deduplicate(docs, stored=is_scan(docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as the mix takes it."""
    return mixture.repeat_rows(docs, stored=is_scan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: tokenized, cut and packed into sequences; workers that four stages have used remember fewer chunks."""
    small_batches(spark)
    return packing.pack_documents(docs, remembered=250_000)


STAGES = [("quality rules", keep_good), ("near-dedup", drop_copies), ("substring dedup", drop_passages),
          ("mixing", mix_sources), ("packing", pack)]

#: Fingerprints and tokens can't be written in SQL; tests/llm compares each stage's operator with a plain version, and the run with its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
