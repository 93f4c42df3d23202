"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents in 16 bits each (32 for larger
vocabularies), the document ends as an Elias-Fano sequence with a sampled select
directory, and the document ids as a second Elias-Fano sequence.  Files are
written by the tasks into a folder that all executors reach, under their final
name only when complete; their bytes depend on the input alone, so a repeated
task writes the same file again.

Defined cases: null text is empty and holds the end id only; null ids come first;
repeated ids keep one entry each, in an order fixed by the text; an empty table
writes no file and gives an empty result.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import land, pieces, store_of, table
from emberline.llm.encode import encoder
from emberline.llm.registry import query
from emberline.operators.ordered import running_total
from emberline.session import checkpoint_dir

END_ID, VOCABULARY = 0, "byte_bpe_50k.json"
#: A file is closed beyond this many bytes of ids or documents.
FILE_BYTES, FILE_DOCS = 32 << 20, 1 << 17
MAGIC = b"EFIDS001"


class EliasFano:
    """A non-decreasing sequence below ``universe`` in about 2 + log2(universe / n) bits a value.

    The upper bits are a unary bit vector; ``select(i)`` finds its i-th one from a
    32-bit directory entry for every ``EVERY`` ones and a popcount over the words after it.
    """

    EVERY = 256

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        shift = np.uint64(low_bits)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> shift).astype(np.int64) + np.arange(n)
        upper = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        upper[ones] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(upper, bitorder="little"),
                   ones[::cls.EVERY].astype("<u4"))

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.uint64)
        bits = np.arange(first * self.low_bits, (first + count) * self.low_bits)
        got = (self.low[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
        return (got.reshape(count, -1).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value."""
        at = int(self.directory[i // self.EVERY])
        left, word = i % self.EVERY, at >> 6
        words = self.high.view("<u8")
        bits = int(words[word]) >> (at & 63) << (at & 63)
        while (ones := bits.bit_count()) <= left:
            left, word = left - ones, word + 1
            bits = int(words[word])
        for _ in range(left):
            bits &= bits - 1
        place = 64 * word + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | int(self._low(i, 1)[0])

    def values(self) -> np.ndarray:
        """All values, as unsigned 64-bit."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(0, self.n)

    def to_bytes(self) -> bytes:
        return (struct.pack("<QIQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.directory))
                + self.low.tobytes() + self.high.tobytes() + self.directory.tobytes())

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, low_bits, low, high, marks = struct.unpack_from("<QIQQQ", data)
        at = struct.calcsize("<QIQQQ")
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (4 * marks, "<u4")):
            parts.append(np.frombuffer(bytes(data[at:at + size]), kind))
            at += size
        return cls(n, low_bits, *parts), data[at:]


def file_bytes(ids: bytes, width: int, ends: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """One file: magic, width, nulls, smallest id; boundaries; document ids; ids."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    offsets = (known.view(np.uint64) - np.uint64(base % 2**64)) if len(known) else np.zeros(0, np.uint64)
    names = EliasFano.encode(offsets, int(offsets[-1]) + 1 if len(known) else 1)
    bounds = EliasFano.encode(ends, int(ends[-1]) + 1)
    return b"".join([MAGIC, struct.pack("<IQq", width, len(doc_ids) - len(known), base), bounds.to_bytes(), names.to_bytes(), ids])


def parse_file(data: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """Document ids, boundaries and ids of a file."""
    view = memoryview(data)
    if bytes(view[:8]) != MAGIC:
        raise ValueError("not a token-id file")
    width, nulls, base = struct.unpack_from("<IQq", view, 8)
    bounds, view = EliasFano.from_bytes(view[8 + struct.calcsize("<IQq"):])
    names, view = EliasFano.from_bytes(view)
    doc_ids = (names.values() + np.uint64(base % 2**64)).view(np.int64).tolist() if names.n else []
    return [None] * nulls + doc_ids, bounds, np.frombuffer(view, f"<u{width}")


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the files in ascending id order; returns their list (task, file, docs, ids, path)."""
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
               .withColumn("_tie", F.xxhash64("text")))
    ordered = ordered.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, context = encoder(vocabulary), TaskContext.get()
        end = np.array([end_id], coder.dtype).tobytes()
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        made, chunks, doc_ids, sizes, held = [], [], [], [], 0

        def close() -> None:
            nonlocal held
            if not doc_ids:
                return
            ends = np.cumsum(np.array(sizes, np.int64) // coder.dtype.itemsize)
            name = f"{root}/part-{context.partitionId():06d}-{len(made):05d}.ids"
            draft = f"{name}.{context.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(file_bytes(b"".join(chunks), coder.dtype.itemsize, ends, doc_ids))
            try:
                store.move(draft, name)
            except OSError:        # a store that doesn't replace: another attempt has put the same file there
                store.delete_file(draft)
            made.append((context.partitionId(), len(made), len(doc_ids), int(ends[-1]), f"{folder}/{name.rpartition('/')[2]}"))
            chunks.clear(), doc_ids.clear(), sizes.clear()
            held = 0

        gc.disable()            # the encoder's maps hold no cycles
        try:
            for batch in batches:
                for part in pieces(batch, "text"):
                    for doc_id, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                        ids = coder.encode(t or "") + end
                        chunks.append(ids)
                        doc_ids.append(doc_id)
                        sizes.append(len(ids))
                        held += len(ids)
                        if held >= FILE_BYTES or len(doc_ids) >= FILE_DOCS:
                            close()
            close()
        finally:
            gc.enable()
        yield pa.RecordBatch.from_arrays([pa.array([m[j] for m in made], t) for j, t in enumerate(
            (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["task", "file", "docs", "ids", "path"])

    return ordered.mapInArrow(write, "task int, file int, docs bigint, ids bigint, path string")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone and their order."""
    based = running_total(files, ["task", "file"], "ids", "_upto").select("path", (F.col("_upto") - F.col("ids")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, name = store_of(path)
                with store.open_input_stream(name) as f:
                    doc_ids, bounds, ids = parse_file(f.read())
                ends = bounds.values().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4").view(np.uint8)
                crc = [zlib.crc32(wide[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A stated number: the list is tiny, and merged partitions would leave all files to one task.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(tasks, "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


@query("op6_elias_fano")
def op6_elias_fano(spark, sf_dir):
    folder = f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    files = land(write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY)), "ids-files")
    return read_ids(files)
