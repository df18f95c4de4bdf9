"""Merging without whole grids: points are keyed by the slab of the grid that they touch, spread there, and transformed over slabs.

A point's Gaussian covers 2 SPREAD planes of a grid of twice the side (``kernels.GriddedNufft``, the same weights); it goes to each slab
that has one of them, and a slab's task adds only what falls on its own planes, so slabs need no halo afterwards. Points crowd in the
middle of the grid: a slab's points are dealt to several tasks, which hand on one partial slab each, and those are added as a
stream. A task holds one slab of ``thick`` planes, whatever the number of points and the side. A grid no wider than the Gaussian is
touched whole by every point: there points aren't dealt out, and each task adds them to small grids of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, merging, slabs
from .slabs import _groups, _map, _rows

#: Tasks that a slab's points are dealt to.
SALTS = 8
#: Points that are spread together; on a grid narrower than the Gaussian, as products of matrices.
CHUNK, NARROW_CHUNK = 128, 2048
#: Grids narrower than the Gaussian (at most 175 KB each) that a task holds open.
OPEN = 64


def spread(points: DataFrame, n: int, thick: int) -> DataFrame:
    """Slabs of the real grid of side 2n that points (vol_id, h, k, l in radians, v) are spread on; slabs without a point are zeros.

    thick divides 2n. Volumes without a point have no rows.
    """
    g = kernels.GriddedNufft(n)
    if g.m <= 2 * g.SPREAD:
        return _added(_map(points.select(F.col("vol_id").cast("long"), *[F.col(c).cast("double") for c in ("h", "k", "l", "v")]), _narrow(g, thick)))
    m, near, step = g.m, g.SPREAD, 2 * math.pi / g.m
    blocks, width = m // thick, thick * m * m
    first = F.floor(F.col("h") / step).cast("long") - near + 1
    touched = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(2 * near - 1)), lambda i: F.floor(F.pmod(first + i, F.lit(m)) / thick).cast("int")))
    # every slab gets at least a row of its own, so that a transform finds all of them
    none = points.select("vol_id").distinct().select("vol_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *[F.lit(0.0).alias(c) for c in ("h", "k", "l", "v")])
    rows = points.select(F.col("vol_id").cast("long").alias("vol_id"), F.explode(touched).alias("block"), *[F.col(c).cast("double").alias(c) for c in ("h", "k", "l", "v")]).unionByName(none)
    salt = F.pmod(F.xxhash64("h", "k", "l", "v"), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("salt", salt).repartition("vol_id", "block", "salt").sortWithinPartitions("vol_id", "block", "salt")

    def add(grid: np.ndarray, block: int, h: np.ndarray, k: np.ndarray, l: np.ndarray, v: np.ndarray) -> None:
        for a in range(0, len(h), CHUNK):
            s = slice(a, a + CHUNK)
            (ih, wh), (ik, wk), (il, wl) = (g._near(p[s]) for p in (h, k, l))
            # only planes of this slab; a grid narrower than the Gaussian meets a plane more than once
            p, c = np.nonzero(ih // thick == block)
            at = ((ih[p, c] - block * thick)[:, None, None] * m + ik[p][:, :, None]) * m + il[p][:, None, :]
            w = (v[s][p] * wh[p, c])[:, None, None] * wk[p][:, :, None] * wl[p][:, None, :]
            grid += np.bincount(at.ravel(), w.ravel(), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, grid = None, None
        for b in (b for b in batches if b.num_rows):
            vol, block, salt, *rest = (b.column(c).to_numpy() for c in ("vol_id", "block", "salt", "h", "k", "l", "v"))
            cuts = np.flatnonzero((np.diff(vol) != 0) | (np.diff(block) != 0) | (np.diff(salt) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(vol)], strict=True):
                now = (int(vol[a]), int(block[a]), int(salt[a]))
                if now != key:
                    if key is not None:
                        yield from _rows(np.array([key[0]]), np.array([key[1]]), key[2], grid[None])
                    key, grid = now, np.zeros(width)
                add(grid, now[1], *(x[a:z] for x in rest))
        if key is not None:
            yield from _rows(np.array([key[0]]), np.array([key[1]]), key[2], grid[None])

    return _added(_map(rows, run))


def _narrow(g: kernels.GriddedNufft, thick: int):
    """Slabs of a grid that is no wider than the Gaussian. Each point touches all of it, so points stay where they are, and a task hands on its own sums."""
    m, blocks = g.m, g.m // thick

    def weights(p: np.ndarray) -> np.ndarray:
        """Of each point on each plane; a plane that is met more than once has the sum."""
        at, w = g._near(p)
        out, row = np.zeros((len(p), m)), np.arange(len(p))
        for c in range(at.shape[1]):
            out[row, at[:, c]] += w[:, c]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[int, np.ndarray] = {}
        task = TaskContext.get().partitionId()

        def close() -> Iterator[pa.RecordBatch]:
            if grids:
                yield from _rows(np.repeat(np.array(list(grids)), blocks), np.tile(np.arange(blocks), len(grids)), task, np.stack(list(grids.values())))
            grids.clear()

        for b in (b for b in batches if b.num_rows):
            vol, *rest = (b.column(c).to_numpy() for c in range(5))
            for one in np.unique(vol).tolist():
                if one not in grids and len(grids) >= OPEN:
                    yield from close()
                own = np.flatnonzero(vol == one)
                for a in range(0, len(own), NARROW_CHUNK):
                    h, k, l, v = (x[own[a : a + NARROW_CHUNK]] for x in rest)
                    wide = (weights(k)[:, :, None] * weights(l)[:, None, :]).reshape(len(v), m * m)
                    grids[one] = grids.get(one, 0) + (weights(h) * v[:, None]).T @ wide
        yield from close()

    return run


def _added(parts: DataFrame) -> DataFrame:
    """One row for each slab: the sum of its parts, of which a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            for vol, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                own = np.frombuffer(data, dtype="<f8")
                if (vol, block) == key:
                    total = total + own
                else:
                    if key is not None:
                        yield from _rows(np.array([key[0]]), np.array([key[1]]), 0, total[None])
                    key, total = (vol, block), own
        if key is not None:
            yield from _rows(np.array([key[0]]), np.array([key[1]]), 0, total[None])

    return _map(parts.repartition("vol_id", "block").sortWithinPartitions("vol_id", "block", "part"), run)


def type1(points: DataFrame, n: int, grid_thick: int, thick: int) -> DataFrame:
    """Slabs of the real part of sum v exp(i (h x + k y + l z)) on a cube of side n with its origin in the middle: points are spread, transformed over slabs, cut and deconvolved.

    grid_thick divides 2n and thick divides n.
    """
    g = kernels.GriddedNufft(n)
    m, undo, half = g.m, g.undo, n // 2
    pencils = slabs.forward(spread(points, n, grid_thick), m, grid_thick)
    keep = (np.arange(n) - half) % m
    place = {int(f): i for i, f in enumerate(keep)}

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a pencil, the lines that lie in the cube, cut into pieces for its slabs: (vol_id, slab, line, thick x n values)."""
        for b in (b for b in batches if b.num_rows):
            for vol, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                f = np.frombuffer(data, dtype="<c16").reshape(m, grid_thick, m)
                own = [(j, place[block * grid_thick + j]) for j in range(grid_thick) if block * grid_thick + j in place]
                for j, to in own:
                    x = f[keep, j][:, keep].real * undo[:, None] * undo[to] * undo
                    yield from _rows(np.full(n // thick, vol), np.arange(n // thick), to, x.reshape(n // thick, -1))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vol, block, raw in _groups(batches, n):
            x = np.ascontiguousarray(raw).view("<f8").reshape(len(vol), n, thick, n).transpose(0, 2, 1, 3)
            yield from _rows(vol, block, 0, x)

    return _map(slabs._exchange(_map(pencils, lines), [], 0), together)


def points_of(images: DataFrame, det: np.ndarray) -> DataFrame:
    """vol_id, h, k, l, v: every pixel of oriented images (member, q, data), turned back by its image's rotation. det: 3 x pixels in radians."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            at = np.stack([kernels.matrix_of(np.array(q)).T @ det for q in b.column(1).to_pylist()])
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)
            cols = [np.repeat(b.column(0).to_numpy(), det.shape[1]), *(np.ascontiguousarray(at[:, i]).ravel() for i in range(3)), v]
            yield pa.record_batch([pa.array(c) for c in cols], names=["vol_id", "h", "k", "l", "v"])

    return images.select(F.col("member").cast("long"), "q", F.col("data").cast("array<double>")).mapInArrow(run, "vol_id long, h double, k double, l double, v double")


def normal_equations(images: DataFrame, det: np.ndarray, n: int, thick: int) -> tuple[DataFrame, DataFrame]:
    """(slabs of the right-hand side, pencils of the kernel's transform for ``slabs.convolve``) of each member; thick divides n."""
    points = points_of(images, det)
    rhs = type1(points, n, thick, thick)
    kernel = slabs.written(type1(points.withColumn("v", F.lit(1.0)), 2 * n, thick, thick))
    rolled = slabs.roll(kernel, 2 * n, thick, n)  # the origin, in the middle, comes to index 0
    f = slabs.forward(rolled, 2 * n, thick)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            for vol, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                x = np.frombuffer(data, dtype="<c16")
                yield from _rows(np.array([vol]), np.array([block]), 0, np.concatenate([x.real, x.imag])[None])

    return slabs.written(rhs), slabs.written(_map(f, parts))


def solve(images: DataFrame, det: np.ndarray, n: int, thick: int, rlambda: float, flambda: float, steps: int, oversampling: float = 1.0) -> DataFrame:
    """Slabs of each member's solution after ``steps`` of conjugate gradients from nothing: all of it over slabs."""
    rhs, kernel = normal_equations(images, det, n, thick)
    outside = merging.outside_ball(n, oversampling)
    return slabs.conjugate_gradient(lambda p: slabs.normal_product(p, kernel, outside, rlambda, flambda, n, thick), rhs, n, thick, steps)
