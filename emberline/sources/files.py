"""Listing and byte ranges of landed files, for readers that split files themselves."""

from __future__ import annotations

import fnmatch
import os.path
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class Landed:
    path: str           # inside the file system
    uri: str            # as users write it
    size: int


def open_store(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path inside it and the prefix that makes a URI of such a path."""
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")), "file://"
    store, inside = fs.FileSystem.from_uri(path)
    return store, inside, path.rstrip("/")[:-len(inside.rstrip("/"))]


def landed(path: str, recursive: bool = False, pattern: str | None = None) -> list[Landed]:
    """Data files under a file, folder or ``*`` name, by path; hidden ones and markers are left out."""
    name = posixpath.basename(path.rstrip("/"))
    if any(c in name for c in "*?["):
        path, pattern = path.rstrip("/")[:-len(name)] or "/", name
    store, inside, prefix = open_store(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = [f for f in store.get_file_info(fs.FileSelector(inside, recursive=recursive)) if f.type == fs.FileType.File]
    else:
        raise FileNotFoundError(path)
    shown = [f for f in found if not any(p.startswith((".", "_")) for p in f.path[len(inside):].strip("/").split("/")) or f is info]
    return sorted((Landed(f.path, prefix + f.path, f.size) for f in shown if pattern is None or fnmatch.fnmatch(posixpath.basename(f.path), pattern)),
                  key=lambda f: f.path)


def ranges(size: int, most: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about equal size that cover a file."""
    n = max(1, -(-size // most))
    for i in range(n):
        yield size * i // n, size * (i + 1) // n


def whole_lines(store: fs.FileSystem, path: str, start: int, stop: int, block: int = 1 << 20) -> tuple[int, bytes]:
    """The lines that begin in [start, stop), and the place of the first of them."""
    with store.open_input_file(path) as f:
        size = f.size()
        at = max(0, start - 1)
        body = bytearray(f.read_at(min(stop, size) - at, at))
        if start:                                   # a line that began before is another range's
            first = body.find(b"\n") + 1
            if not first:
                return stop, b""
        else:
            first = 0
        if at + first >= stop:
            return stop, b""
        end = at + len(body)
        while body[-1:] != b"\n" and end < size:     # the last line ends later
            more = f.read_at(block, end)
            cut = more.find(b"\n") + 1
            body += more[:cut] if cut else more
            end += cut or len(more)
            if cut:
                break
    return at + first, bytes(body[first:])
