"""A Python data source that reads one large file as many tasks: row ranges of NumPy arrays, page ranges of paged files.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RangeSource)
    spark.read.format("ranges").option("path", "/data/vectors.npy").option("rows", 100_000).load()

``kind`` is "npy" (a matrix: ref long, embedding array<float>) or "pages" (a text file whose pages end with a form feed:
page int, text string). Filters on ref or page are pushed into the ranges, so partitions that they rule out aren't made.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Rows, or pages, of a partition; bytes that are read at once.
ROWS, CHUNK = 100_000, 1 << 20
KINDS = {"npy": ("ref", "ref long, embedding array<float>"), "pages": ("page", "page int, text string")}


class Matrix(NamedTuple):
    """Where the values of a .npy file begin, of what type they are, and their shape."""

    offset: int
    dtype: str
    rows: int
    columns: int


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, at: int):
        self.path, self.first, self.last, self.at = path, first, last, at


def _files(path: str) -> list[str]:
    """The files of a path, or of the folder that it names, in order."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return [prefix + x.path for x in sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda x: x.path) if x.type == fs.FileType.File]


def _open(path: str):
    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def matrix_of(path: str) -> Matrix:
    """The header of a .npy file: a matrix in row order."""
    with _open(path) as f:
        head = f.read(12)
        if head[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} isn't a NumPy file")
        size, begin = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
        f.seek(begin)
        told = ast.literal_eval(f.read(size).decode("latin1"))
    if told["fortran_order"] or len(told["shape"]) != 2:
        raise ValueError(f"{path} isn't a matrix in row order")
    return Matrix(begin + size, told["descr"], *told["shape"])


def page_starts(path: str, every: int) -> tuple[list[int], int]:
    """The byte offsets of every ``every``-th page, and how many pages there are, by a scan in chunks that keeps no text."""
    starts, pages, at, last = [0], 0, 0, b""
    with _open(path) as f:
        while chunk := f.read(CHUNK):
            ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 12)
            for k, end in enumerate(ends, pages + 1):
                if k % every == 0:
                    starts.append(at + int(end) + 1)
            pages, at, last = pages + len(ends), at + len(chunk), chunk[-1:]
    if at and last != b"\x0c":
        pages += 1
    return starts, pages


class RangeReader(DataSourceReader):
    def __init__(self, path: str, kind: str, rows: int):
        self.path, self.kind, self.rows = path, kind, rows
        self.low, self.high = 0, None  # inclusive bounds of ref or page

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = getattr(f, "attribute", None) == (KINDS[self.kind][0],) and isinstance(getattr(f, "value", None), int)
            if own and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if own and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                top = f.value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            yield f  # ranges are coarse: Spark filters the rows

    def partitions(self) -> list[Range]:
        out, before = [], 0
        for path in _files(self.path):
            if self.kind == "npy":
                m = matrix_of(path)
                starts, n = [m.offset + k * m.columns * np.dtype(m.dtype).itemsize for k in range(0, m.rows, self.rows)], m.rows
            else:
                starts, n = page_starts(path, self.rows)
            for k, at in enumerate(starts):
                first, last = before + k * self.rows, before + min((k + 1) * self.rows, n)
                if first < last and last > self.low and (self.high is None or first <= self.high):
                    out.append(Range(path, first, last, at))
            before += n
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        n = partition.last - partition.first
        with _open(partition.path) as f:
            if self.kind == "npy":
                m = matrix_of(partition.path)
                f.seek(partition.at)
                step = max(1, CHUNK // max(1, m.columns * np.dtype(m.dtype).itemsize))
                for lo in range(0, n, step):
                    some = min(step, n - lo)
                    values = np.frombuffer(f.read(some * m.columns * np.dtype(m.dtype).itemsize), m.dtype).reshape(some, m.columns)
                    for k, row in enumerate(values.astype(np.float32)):
                        yield partition.first + lo + k, row.tolist()
                return
            f.seek(partition.at)
            held, page = b"", partition.first
            while page < partition.last:
                chunk = f.read(CHUNK)
                *full, held = (held + chunk).split(b"\x0c") if chunk else (held, b"")
                for text in full[: partition.last - page]:
                    yield page, text.decode("utf-8", "replace")
                    page += 1


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ranges"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "npy")][1]

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"], self.options.get("kind", "npy"), int(self.options.get("rows", ROWS)))
