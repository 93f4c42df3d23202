"""Shared parts: landed tables, Arrow text access, tokens, hashes, tolerant inputs."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import checkpoint_dir, cut

#: ASCII white space of the token rule ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_SPACE = np.isin(np.arange(256), list(SPACES))
TOKEN = r"[^\x20\x09-\x0D]+"
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files.

    Python-heavy stages then run once, and a lost executor costs no recomputation
    beyond the stage that is running.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Read texts and hand them to Python in small batches: a task holds several copies of a batch, in both processes.

    Scans fill their column vectors by as many rows, so that those stay small beside
    the heap.  The files of a query's shuffles go when it ends: the rounds of a stage
    have many small ones.  Results don't depend on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", rows)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def release_memory() -> None:
    """Give back what earlier tasks of this worker took and freed; workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)         # glibc has it
    if trim:
        trim(0)


def clean_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet, for working columns."""
    name = wanted
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def held_out() -> Column:
    return F.coalesce(F.expr(HELD_OUT), F.lit(False))


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text stays near ``most_bytes`` (one long text may exceed it)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and its n + 1 offsets, from zero."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column]) if column.offset else column
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits (a multiply-xorshift finisher, in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: One random 64-bit number for each byte value.
BYTE_KEYS = np.random.default_rng(20231).integers(0, 2**64, 256, np.uint64)


def schema_of(df: DataFrame, *fields: str) -> str:
    """DDL of ``df``'s fields followed by ``fields``."""
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*own, *fields])


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that executors reach, for use inside tasks."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` still tells the file and place of its rows, as ``number_rows`` needs it; a stage's reread input does."""
    try:
        docs.metadataColumn("_metadata")
    except AnalysisException:
        return False
    return True


def number_rows(docs: DataFrame) -> DataFrame:
    """Add ``_row`` to a file scan: the file's place among the sorted paths, then the row's place in its file.

    Neither depends on how a job splits the files, so every job gives a row the
    same number, whatever executors it runs on.
    """
    meta, path = docs.metadataColumn("_metadata"), clean_name(docs, "_path")
    paths = sorted(r[0] for r in docs.select(meta["file_path"]).distinct().collect())         # the driver lists the files anyway
    files = docs.sparkSession.createDataFrame([(p, i << FILE_BITS) for i, p in enumerate(paths)], f"{path} string, _file_at long")
    placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], meta["file_path"].alias(path), meta["row_index"].alias("_row"))
    return placed.join(F.broadcast(files), path).select(
        *[F.col(f"`{c}`") for c in docs.columns], (F.col("_file_at") + F.col("_row")).alias("_row"))


#: Bits of ``_row`` that hold the place in the file, and those that count within a block of side rows.
FILE_BITS, BLOCK_BITS = 33, 12


def lay_beside(side: DataFrame, name: str) -> str:
    """Store ``side`` (_row, ...) in blocks of row numbers, for ``Beside``; returns the folder.

    A scan task looks up the blocks of the rows it reads: rows and their text then
    meet without moving any text.
    """
    folder = f"{checkpoint_dir(side.sparkSession)}/{name}-{uuid.uuid4().hex}"
    by_block = side.withColumn("block", F.shiftright("_row", BLOCK_BITS)).repartition("block").sortWithinPartitions("block", "_row")
    by_block.write.partitionBy("block").parquet(folder)
    return folder


class Beside:
    """What ``lay_beside`` stored, read in a task as its rows come by; only the blocks of the last rows are held."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, {}

    def of(self, own: np.ndarray) -> tuple[np.ndarray, pa.Table | None]:
        """How many side rows each row number of ``own`` has, and these in the order of ``own``; None if there are none."""
        self.held = {b: self.held[b] if b in self.held else self._read(b) for b in np.unique(own >> BLOCK_BITS).tolist()}
        tables = [t for t in self.held.values() if t is not None]
        if not tables:
            return np.zeros(len(own), np.int64), None
        side = pa.concat_tables(tables)
        rows = side.column("_row").to_numpy()
        low = np.searchsorted(rows, own)
        many = np.searchsorted(rows, own, "right") - low
        spot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        return many, side.take(pa.array(spot)) if len(spot) else None

    def _read(self, block: int) -> pa.Table | None:
        store, root = store_of(f"{self.folder}/block={block}")
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return None
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        held = pa.concat_tables([self._read_file(store, f) for f in files])
        pa.default_memory_pool().release_unused()                      # workers live on: what decoding took goes back
        return held

    @staticmethod
    def _read_file(store: fs.FileSystem, path: str) -> pa.Table:
        """A small file, read by this thread alone: each further thread would keep memory of its own."""
        with store.open_input_file(path) as file:
            return pq.ParquetFile(file).read(use_threads=False)


def keep_beside(rows: DataFrame, side: DataFrame, name: str) -> DataFrame:
    """The stored ``rows`` (_row, ...) whose number is in ``side``, without moving them."""
    folder = lay_beside(side.select("_row"), name)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = Beside(folder)
        for batch in batches:
            many, _ = beside.of(batch.column("_row").to_numpy())
            yield batch.filter(pa.array(many > 0))

    return rows.mapInArrow(choose, schema_of(rows))


def link_groups(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); component = smallest id that can be reached.

    By contraction: each node points to its smallest neighbour, pointers are doubled
    to their roots, and only links between different roots go on, each once.  Dense
    groups so shrink to one node in the first rounds, and their links are read once
    instead of in each round.  Self links and null ids count for nothing.  Pointers only lead to smaller ids, so the smallest id
    of a group stays a root to the end.
    """
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    levels = []
    while not edges.isEmpty():
        ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("to")),
                                             F.struct(F.col("b").alias("node"), F.col("a").alias("to")))))
        roots = cut(ends.groupBy("node").agg(F.min("to").alias("root")))
        while True:
            upper = roots.select(F.col("node").alias("up"), F.col("root").alias("upper"))
            moved = cut(roots.join(upper, F.col("root") == F.col("up")).select("node", F.col("root").alias("old"), F.col("upper").alias("root")))
            roots = moved.select("node", "root")
            if moved.filter("root <> old").isEmpty():
                break
        levels.append(roots)
        first = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").select("ra", "b").distinct()
        both = first.join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").filter("ra <> rb")
        edges = cut(both.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # From the last round back: the root of a node's root.
    out = levels.pop()
    while levels:
        top = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = levels.pop().join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out.select("node", F.col("root").alias("component"))
