"""Nearest reference of every image.

The references of a reconstruction are slices of a model: the model and the orientations go to the tasks (a few MB), and the
slices are made where they are compared, so images are never shuffled and keep their best so far from block to block. References
of any other kind are a table of any size, and both sides are joined on executors (``nearest``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .nearest import k_nearest

#: Values of images that are compared together, and of slices made together: 32 MB of doubles each.
CHUNK_VALUES = 4 << 20
#: Values of slices that a Python worker keeps for its further tasks; of more than that it makes the slices anew for each chunk of images.
HELD_VALUES = 16 << 20


def distance(a: str, b: str, weight: str | None = None) -> Column:
    """Squared Euclidean distance of two array columns, weighted by a third one."""
    names = [a, b, *([weight] if weight else [])]
    term = lambda s: (s[names[0]] - s[names[1]]) * (s[names[0]] - s[names[1]]) * (s[names[2]] if weight else F.lit(1.0))
    pairs = F.arrays_zip(*names)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + term(s))


def _wide(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


_held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}


def _slices(volume: np.ndarray, quats: np.ndarray, det: np.ndarray, first: int, last: int) -> np.ndarray:
    """The model's transform on the detector at orientations first to last - 1."""
    n = volume.shape[0]
    grid = kernels.GriddedNufft(n) if n >= kernels.GRIDDING_FROM else None
    at = [kernels.matrix_of(q).T @ det for q in quats[first:last]]
    return np.stack([(grid.type2(volume, *p) if grid else kernels.nufft2(volume, *p)).real for p in at])


def _scaled(rows: np.ndarray, scale: tuple[str, float], total: tuple[float, float, float] | None) -> np.ndarray:
    how, std = scale
    if how == "none":
        return rows
    own = rows.std() if how == "batch" else np.sqrt(max(0.0, total[2] / total[0] - (total[1] / total[0]) ** 2))
    return rows * (std / own) if own else rows


def model_blocks(shared: Broadcast, batch: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first orientation, slices, their squared norms) of blocks of ``batch`` orientations; kept by the worker if all of them are few."""
    name, volume, quats, det, scale, total = shared.value
    few = len(quats) * det.shape[1] <= HELD_VALUES
    if few and name not in _held:
        _held.clear()
    made = _held.setdefault(name, []) if few else []
    for i, first in enumerate(range(0, len(quats), batch)):
        if i < len(made):
            rows, norm = made[i]
        else:
            rows = _scaled(_slices(volume, quats, det, first, first + batch), scale, total)
            norm = (rows * rows).sum(1)
            if few:
                made.append((rows, norm))
        yield first, rows, norm


def match_model(images: DataFrame, volume: np.ndarray, quats: np.ndarray, det: np.ndarray, scale: str = "global", batch: int = 1000) -> DataFrame:
    """image_id, q, distance, data: each image with the orientation whose slice of the model is nearest, ties by the lower orientation.

    images: image_id, data; det: 3 x pixels in radians. ``scale`` brings the slices' standard deviation to the images': all slices
    together (global), each ``batch`` of orientations for itself (batch), or not at all (none). The slices are made in the tasks
    that compare them, so nothing but the model, the orientations and the detector is sent, and no image is shuffled. No images
    or no orientations give no rows.
    """
    if scale not in ("global", "batch", "none"):
        raise ValueError(f"scale is 'global', 'batch' or 'none', not {scale!r}")
    spark = images.sparkSession
    quats = np.asarray(quats, dtype=np.float64).reshape(-1, 4)
    pixels = det.shape[1]
    batch = max(1, min(batch, CHUNK_VALUES // pixels))
    schema = "image_id long, q array<double>, distance double, data array<double>"
    if not len(quats):
        return spark.createDataFrame([], schema)
    std = 1.0 if scale == "none" else std_of(images)
    total = model_sums(spark, volume, quats, det, batch) if scale == "global" and std is not None else None
    if std is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, volume, quats, det, (scale, std), total))
    most = max(1, CHUNK_VALUES // pixels)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, most):
                held.append(b.slice(at, most))
                n += held[-1].num_rows
                if n >= most:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            x = _wide(t.column("data").combine_chunks(), len(t))
            own = (x * x).sum(1)
            best, at = np.full(len(t), np.inf), np.zeros(len(t), dtype=np.int64)
            for first, rows, norm in model_blocks(shared, batch):
                d = np.maximum(own[:, None] + norm - 2 * x @ rows.T, 0)
                k = d.argmin(1)
                least = d[np.arange(len(t)), k]
                closer = least < best
                best[closer], at[closer] = least[closer], first + k[closer]
            q = pa.array(list(shared.value[2][at]), pa.list_(pa.float64()))
            yield from pa.table([t.column("image_id"), q, pa.array(best), t.column("data")], names=["image_id", "q", "distance", "data"]).to_batches()

    return images.select("image_id", F.col("data").cast("array<double>").alias("data")).mapInArrow(run, schema)


def model_sums(spark, volume: np.ndarray, quats: np.ndarray, det: np.ndarray, batch: int) -> tuple[float, float, float]:
    """Number, sum and sum of squares of all values of all slices, by blocks of orientations."""
    shared = spark.sparkContext.broadcast((volume, quats, det))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_slices(*shared.value, first, first + batch) for first in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([float(f(r)) for r in rows]) for f in (np.size, np.sum, lambda r: (r * r).sum())], names=["n", "s", "ss"])

    firsts = spark.range(0, len(quats), batch, max(1, min(spark.sparkContext.defaultParallelism, -(-len(quats) // batch))))
    return tuple(firsts.mapInArrow(run, "n double, s double, ss double").agg(F.sum("n"), F.sum("s"), F.sum("ss")).first())


def std_of(images: DataFrame) -> float | None:
    """The standard deviation of all values of all images: three sums of each row, no row for each value. None if there are no values."""
    value = F.transform("data", lambda v: v.cast("double"))
    total = lambda of: F.aggregate(of, F.lit(0.0), lambda acc, v: acc + v)
    sums = images.select(F.size("data").alias("n"), total(value).alias("s1"), total(F.transform(value, lambda v: v * v)).alias("s2"))
    n, s, ss = sums.agg(F.sum("n"), F.sum("s1"), F.sum("s2")).first()
    return float(np.sqrt(max(0.0, ss / n - (s / n) ** 2))) if n else None


def std_scale(images: DataFrame, refs: DataFrame) -> Column:
    """The factor that brings the references' standard deviation to the images', over all values of both."""
    a, b = std_of(images), std_of(refs)
    return F.lit(a / b if a is not None and b else 1.0)


def match(images: DataFrame, refs: DataFrame, scale: bool = True, others: bool = False) -> DataFrame:
    """image_id, ref_id, distance of the best reference, after the references are brought to the images' scale."""
    if scale:
        s = std_scale(images, refs)
        refs = refs.withColumn("data", F.transform("data", lambda v: v * s))
    return k_nearest(images, refs, others=others).drop("rank")


def quality(matched: DataFrame) -> DataFrame:
    return matched.agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"))


def override_known(orient: DataFrame, known: DataFrame, fraction: float, n: int) -> DataFrame:
    """Known orientations in place of the first fraction of the matched ones, by image_id."""
    names = ["w", "x", "y", "z"]
    first = known.where(F.col("image_id") < int(fraction * n)).select("image_id", *[F.col(c).alias(f"known_{c}") for c in names])
    both = orient.join(first, "image_id", "left")
    return both.select("image_id", *[F.coalesce(f"known_{c}", c).alias(c) for c in names])
