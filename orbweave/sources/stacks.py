"""A Spark data source for stacks of images and for volumes in the public MRC2014 format: batch, stream and writer.

A stack is one file: a header, then one section after another (an image of a run, or a plane of a volume). A folder of stacks is one table, in
order of file names; image_id counts sections over all of them.

* Batch: partitions are byte ranges of at most ``bytes`` bytes; ranges of image_id that a query asks for are pushed down, so
  only their bytes are read (with spark.sql.python.filterPushdown.enabled, which ``register`` sets).
* Stream: the offset is a place, (file, section): files before it are done. A file may grow and later names may come; a query that is started
  again goes on within the file where it stopped.
* Writer: tasks write their sections at their fixed places of one staging file; the commit checks that each is there once, writes the
  header from the tasks' sums and renames the file. No section goes to the driver; a failed job leaves the old file and removes its own.

Only headers (1 KB a file) are read on the driver. Files are reached by pyarrow's file systems (paths or URIs); the writer needs one with
writes at any place, such as a shared folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from . import mrc

NAME = "mrc_stack"
SCHEMA = "image_id long, data array<float>"
#: Bytes of a partition, at most (but for a single section).
RANGE_BYTES = 32 << 20


@dataclass
class Stack:
    """What a header says: the sections of a file, their shape, type and where they start."""

    path: str
    sections: int
    rows: int
    cols: int
    kind: str
    start: int

    @property
    def width(self) -> int:
        return self.rows * self.cols * np.dtype(self.kind).itemsize


@dataclass
class Range(InputPartition):
    """Sections first to last - 1 of a file, whose first section has the id ``base``."""

    stack: Stack
    base: int
    first: int
    last: int


def _local(path: str) -> str | None:
    """The path in a folder of this machine or one that it shares; None for other stores."""
    at = urlparse(path)
    return at.path if at.scheme in ("", "file") else None


@contextmanager
def _reading(path: str) -> Iterator[Callable[[int, int], bytes]]:
    """A function that reads (bytes, place)."""
    if (at := _local(path)) is not None:
        with open(at, "rb") as f:
            yield lambda n, place: os.pread(f.fileno(), n, place)
    else:
        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_file(at) as f:
            yield f.read_at


def header(path: str) -> Stack:
    with _reading(path) as read:
        head = np.frombuffer(read(mrc.HEADER, 0), dtype="<i4")
    cols, rows, sections, mode = (int(x) for x in head[:4])
    if mode not in mrc.MODES:
        raise ValueError(f"mode {mode} isn't supported")
    return Stack(path, sections, rows, cols, mrc.MODES[mode], mrc.HEADER + int(head[23]))


def stacks(path: str) -> list[Stack]:
    """The stacks of a file or folder, by name. Names that begin with . or _ are left out."""
    if (at := _local(path)) is not None:
        if not os.path.isdir(at):
            return [header(path)]
        names = [x.name for x in os.scandir(at) if x.is_file()]
    else:
        system, at = fs.FileSystem.from_uri(path)
        if system.get_file_info(at).type != fs.FileType.Directory:
            return [header(path)]
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File]
    return [header(f"{path.rstrip('/')}/{n}") for n in sorted(names) if n[0] not in "._"]


def _ranges(stack: Stack, base: int, first: int, last: int, most: int) -> list[Range]:
    step = max(1, most // max(1, stack.width))
    return [Range(stack, base, a, min(a + step, last)) for a in range(first, last, step)]


def _read(part: Range) -> Iterator[pa.RecordBatch]:
    s = part.stack
    step = max(1, (4 << 20) // max(1, s.width))
    with _reading(s.path) as read:
        for a in range(part.first, part.last, step):
            n = min(step, part.last - a)
            raw = read(n * s.width, s.start + a * s.width)
            if len(raw) < n * s.width:
                raise ValueError(f"{s.path} ends before section {a + n}")
            values = np.frombuffer(raw, dtype=s.kind).astype("<f4")
            offsets = np.arange(n + 1, dtype=np.int32) * (s.rows * s.cols)
            data = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.record_batch([pa.array(np.arange(part.base + a, part.base + a + n)), data], names=["image_id", "data"])


class StackReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.low, self.high = path, most, 0, 1 << 62

    def pushFilters(self, filters):  # noqa: N802 (Spark's name)
        for f in filters:
            kind = type(f)
            if getattr(f, "attribute", None) == ("image_id",) and kind in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                if kind in (EqualTo, GreaterThan, GreaterThanOrEqual):
                    self.low = max(self.low, f.value + (kind is GreaterThan))
                if kind in (EqualTo, LessThan, LessThanOrEqual):
                    self.high = min(self.high, f.value + (kind is not LessThan))
            else:
                yield f

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for s in stacks(self.path):
            out += _ranges(s, base, max(0, self.low - base), min(s.sections, self.high - base), self.most)
            base += s.sections
        return out or [Range(Stack(self.path, 0, 0, 0, "<f4", 0), 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition.last > partition.first else iter(())


class StackStream(DataSourceStreamReader):
    """Offsets: file and section of the first one that isn't read, and how many came before that file."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "section": 0, "before": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        found = stacks(self.path)
        if not found:
            return self.initialOffset()
        return {"file": os.path.basename(found[-1].path), "section": found[-1].sections, "before": sum(s.sections for s in found[:-1])}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out, base = [], start["before"]
        for s in stacks(self.path):
            name = os.path.basename(s.path)
            if start["file"] <= name <= end["file"]:
                first = start["section"] if name == start["file"] else 0
                # what has grown since the offset was taken belongs to the next batch
                last = end["section"] if name == end["file"] else s.sections
                out += _ranges(s, base, first, last, self.most)
                base += s.sections
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


@dataclass
class Written(WriterCommitMessage):
    """Of one task: the sections it wrote, and what the header needs of their values."""

    sections: list[int]
    low: float
    high: float
    total: float
    squares: float


class StackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, sections: int, rows: int, cols: int, voxel: float, origin: tuple[float, float, float]):
        self.path = _local(path)
        if self.path is None:
            raise ValueError("a stack is written where any place of a file can be: a path in a folder that all share")
        self.shape, self.voxel, self.origin = (sections, rows, cols), voxel, origin
        self.staging = os.path.join(os.path.dirname(self.path), f".{os.path.basename(self.path)}-{uuid.uuid4().hex}")
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.staging, "wb") as f:
            f.truncate(mrc.HEADER + 4 * sections * rows * cols)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n, rows, cols = self.shape
        width, got, low, high, total, squares = rows * cols, [], np.inf, -np.inf, 0.0, 0.0
        with open(self.staging, "r+b") as f:
            for b in iterator:
                ids, lengths = b.column(0).to_pylist(), np.diff(b.column(1).offsets.to_numpy())
                if b.column(0).null_count or b.column(1).null_count or (lengths != width).any() or any(not 0 <= i < n for i in ids):
                    raise ValueError(f"a section has an id from 0 to {n - 1} and {width} values")
                values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, width)
                for i, x in zip(ids, values, strict=True):
                    f.seek(mrc.HEADER + 4 * i * width)
                    f.write(x.tobytes())
                got += ids
                if values.size:
                    wide = values.astype(np.float64)
                    low, high, total, squares = min(low, wide.min()), max(high, wide.max()), total + wide.sum(), squares + (wide * wide).sum()
        return Written(got, float(low), float(high), float(total), float(squares))

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        seen = sorted(i for m in told for i in m.sections)
        n, rows, cols = self.shape
        if seen != list(range(n)):
            os.remove(self.staging)
            raise ValueError(f"{n} sections are to be written, each once; there are {len(seen)}, {len(set(seen))} of them different")
        size = n * rows * cols
        mean = sum(m.total for m in told) / size if size else 0.0
        spread = max(0.0, sum(m.squares for m in told) / size - mean * mean) ** 0.5 if size else 0.0
        ends = (min((m.low for m in told), default=0.0), max((m.high for m in told), default=0.0)) if size else (0.0, 0.0)
        with open(self.staging, "r+b") as f:
            f.write(mrc.header_bytes((n, rows, cols), self.voxel, self.origin, (*ends, mean, spread)))
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.staging, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.staging):
            os.remove(self.staging)


class StackSource(DataSource):
    """Options: path; bytes (of a partition). For the writer also sections, rows, cols, voxel and origin (three numbers, by commas)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StackReader:
        return StackReader(self.options["path"], int(self.options.get("bytes", RANGE_BYTES)))

    def streamReader(self, schema) -> StackStream:  # noqa: N802
        return StackStream(self.options["path"], int(self.options.get("bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> StackWriter:
        o = self.options
        path = o["path"]
        if not overwrite and os.path.exists(_local(path) or ""):
            raise ValueError(f"{path} is there; write with mode overwrite")
        origin = tuple(float(x) for x in o.get("origin", "0,0,0").split(","))
        return StackWriter(path, int(o["sections"]), int(o["rows"]), int(o["cols"]), float(o.get("voxel", 1.0)), origin)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark push filters down to it."""
    spark.dataSource.register(StackSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_stacks(spark: SparkSession, path: str, most: int = RANGE_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("bytes", most).load(path)


def write_stack(images: DataFrame, path: str, sections: int, rows: int, cols: int, voxel: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """images: image_id (0 to sections - 1, each once: the place in the stack) and data, to one file; an old one is replaced once the new one is whole."""
    register(images.sparkSession)
    out = images.select(F.col("image_id").cast("long").alias("image_id"), F.col("data").cast("array<float>").alias("data"))
    options = {"sections": sections, "rows": rows, "cols": cols, "voxel": voxel, "origin": ",".join(map(str, origin))}
    out.write.format(NAME).options(**options).mode("overwrite").save(path)
