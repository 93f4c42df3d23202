"""A data source for detection CSV files, whatever their headers: byte ranges of files, parsed with Arrow.

Planning lists the files and cuts them into ranges; a task reads the lines that
begin in its range and, for the header, the first bytes of the file.  Every data
byte is read once.  A row's place is the byte at which its line begins, which
doesn't depend on the ranges.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from emberline.functions.cleaning import COLUMN_ALIASES
from emberline.sources.files import landed, open_store, ranges, whole_lines

#: Bytes of a range; first bytes that are looked at for the header, and more if it is longer.
RANGE_BYTES, HEAD_BYTES = 64 << 20, 1 << 14


@dataclass(frozen=True)
class Head:
    """Header of a file: its delimiter, its names and the place of the first data line."""
    separator: str
    names: tuple[str, ...]
    data: int

    @property
    def columns(self) -> dict[str, list[int]]:
        """Canonical column -> places of its sources; unknown names stay, in lower case."""
        out: dict[str, list[int]] = {}
        for i, raw in enumerate(self.names):
            key = raw.strip().lower()
            out.setdefault(COLUMN_ALIASES.get(key, key), []).append(i)
        return out


def read_head(store: fs.FileSystem, path: str) -> Head | None:
    """The first line that isn't blank (``;`` separates only if it has no comma); None if there is none."""
    with store.open_input_file(path) as f:
        head, size = b"", f.size()
        while True:
            head = f.read_at(min(size, max(HEAD_BYTES, 2 * len(head))), 0)
            at = 3 if head.startswith(b"\xef\xbb\xbf") else 0
            for line in head[at:].splitlines(keepends=True):
                if line.strip() and (line.endswith((b"\n", b"\r")) or len(head) == size):
                    text = line.decode("utf-8", "replace").strip("\r\n")
                    separator = ";" if ";" in text and "," not in text else ","
                    return Head(separator, tuple(next(csv.reader([text], delimiter=separator))), at + len(line))
                at += len(line)
            if len(head) >= size:
                return None


def _slow(body: bytes, head: Head) -> list[pa.Array]:
    """Lines with too few or too many fields: missing ones are null, others are cut off."""
    rows = [next(csv.reader([line], delimiter=head.separator), []) for line in body.decode("utf-8", "replace").split("\n") if line.strip("\r")]
    width = len(head.names)
    rows = [(r + [None] * width)[:width] for r in rows]
    return [pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * width


def parse(body: bytes, at: int, head: Head, wanted: list[str], uri: str) -> pa.RecordBatch:
    """Canonical trimmed columns of whole lines that begin at ``at``; blanks are null, all-blank rows go."""
    raw = np.frombuffer(body, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1]).astype(np.int64)
    ends = np.append(starts[1:] - 1, len(raw))
    size = ends - starts
    filled = (size > 1) | ((size == 1) & (raw[np.minimum(starts, max(0, len(raw) - 1))] != 13)) if len(raw) else np.zeros(1, bool)
    place = starts[filled] + at
    names = [str(i) for i in range(len(head.names))]
    columns = None
    if len(place):
        try:
            table = arrow_csv.read_csv(
                io.BytesIO(body), arrow_csv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, len(body) + 1)),
                arrow_csv.ParseOptions(delimiter=head.separator, newlines_in_values=False),
                arrow_csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, quoted_strings_can_be_null=False))
            if table.num_rows == len(place):
                columns = [c.combine_chunks() for c in table.columns]
        except (pa.ArrowInvalid, UnicodeDecodeError):
            columns = None
    if columns is None:
        columns = _slow(body, head)

    def clean(column: pa.Array) -> pa.Array:
        text = pc.utf8_trim_whitespace(column)
        return pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)

    def one(places: list[int]) -> pa.Array:
        return clean(columns[places[0]]) if len(places) == 1 else pc.coalesce(*[clean(columns[i]) for i in places])

    own = {name: one(places) for name, places in head.columns.items()}
    n = len(place)
    some = np.zeros(n, bool)
    for c in own.values():
        some |= pc.is_valid(c).to_numpy(zero_copy_only=False)
    out = [own.get(c, pa.nulls(n, pa.string())) for c in wanted] + [pa.array([uri] * n, pa.string()), pa.array(place)]
    return pa.RecordBatch.from_arrays(out, names=[*wanted, "_file", "_row"]).filter(pa.array(some))


@dataclass
class Range(InputPartition):
    path: str
    uri: str
    start: int
    stop: int

    def __init__(self, path: str, uri: str, start: int, stop: int):
        self.path, self.uri, self.start, self.stop = path, uri, start, stop


class DetectionCsv(DataSource):
    """Options: path, recursive, pattern, rangeBytes; the columns are the user's schema less ``_file`` and ``_row``."""

    @classmethod
    def name(cls) -> str:
        return "detection_csv"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), [f.name for f in schema.fields if f.name not in ("_file", "_row")])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.columns = columns

    def partitions(self) -> list[Range]:
        most = int(self.options.get("rangebytes", RANGE_BYTES))
        files = landed(self.options["path"], self.options.get("recursive") == "true", self.options.get("pattern"))
        return [Range(f.path, f.uri, a, b) for f in files for a, b in ranges(f.size, most)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _, _ = open_store(self.options["path"].rstrip("*"))
        head = read_head(store, part.path)
        if head is None:
            return
        at, body = whole_lines(store, part.path, part.start, part.stop)
        skip = max(0, head.data - at)
        if len(body) > skip:
            yield parse(body[skip:], at + skip, head, self.columns, part.uri)
