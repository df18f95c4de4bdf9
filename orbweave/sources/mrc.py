"""Volumes in the public MRC2014 format, read and written through Spark's binary files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HEADER = 1024
MODES = {0: "<i1", 1: "<i2", 2: "<f4", 6: "<u2"}


def header_bytes(shape: tuple[int, int, int], voxel: float, origin: tuple[float, float, float], stats: tuple[float, float, float, float]) -> bytes:
    """The header of float32 values; stats: least, largest, mean and standard deviation."""
    nz, ny, nx = shape
    head = np.zeros(HEADER // 4, dtype="<i4")
    real = head.view("<f4")
    head[0:4] = nx, ny, nz, 2
    head[7:10] = nx, ny, nz
    real[10:13] = nx * voxel, ny * voxel, nz * voxel
    real[13:16] = 90.0
    head[16:19] = 1, 2, 3
    real[19:22] = stats[:3]
    head[27] = 20140
    real[49:52] = origin
    raw = bytearray(head.tobytes())
    raw[208:212] = b"MAP "
    raw[212:216] = bytes([0x44, 0x44, 0, 0])
    raw[216:220] = np.array([stats[3]], dtype="<f4").tobytes()
    return bytes(raw)


def to_bytes(vol: np.ndarray, voxel: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> bytes:
    """A float32 cube or box; the last axis is the file's fastest (columns)."""
    data = np.asarray(vol, dtype="<f4")
    stats = (data.min(), data.max(), data.mean(), data.std()) if data.size else (0, 0, 0, 0)
    return header_bytes(data.shape, voxel, origin, stats) + data.tobytes()


def from_bytes(raw: bytes) -> tuple[np.ndarray, float]:
    head = np.frombuffer(raw[:HEADER], dtype="<i4")
    nx, ny, nz, mode = (int(x) for x in head[:4])
    if mode not in MODES:
        raise ValueError(f"mode {mode} isn't supported")
    start = HEADER + int(head[23])
    data = np.frombuffer(raw, dtype=MODES[mode], count=nx * ny * nz, offset=start).reshape(nz, ny, nx)
    return data.astype(np.float64), float(head.view("<f4")[10]) / max(1, int(head[7]))


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """path, side (i, j, k sizes), voxel, data for each file under ``path``, in any store that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [from_bytes(x) for x in b.column(1).to_pylist()]
            yield pa.record_batch(
                [b.column(0), pa.array([list(v.shape) for v, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.float64()), pa.array([v.ravel() for v, _ in got], pa.list_(pa.float64()))],
                names=["path", "side", "voxel", "data"],
            )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, side array<int>, voxel double, data array<double>")


def write_volume(spark: SparkSession, path: str, vol: np.ndarray, voxel: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> None:
    """One file, replaced if there is one, in any store that Spark writes. A volume has a fixed size, so the driver holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(to_bytes(vol, voxel, origin)))
    finally:
        out.close()
