"""A nested grid of rotations, and exact matching from coarse to fine over it.

A rotation is a place on the sphere and an angle about it (Hopf's fibration): height in -1 to 1 and two angles, in which uniform
rotations are uniform. A cell of level l is one of 2^l equal parts of each of the three; its eight children have the numbers 8 c to 8 c + 7.
In order of the finest cells, each cell of each level is a run of orientations.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quaternion import Quat
from . import matching

#: Orientations of a finest cell, about.
LEAF = 2
#: Part of |image|^2 + |slice|^2 by which a bound may be off through rounding.
SLACK = 1e-10


def cell_of(q: Quat, level: int) -> Column:
    """The cell of a rotation's quaternion (either sign) at a level up to 20."""
    w, x, y, z = q
    a, b = F.atan2(z, w), F.atan2(y, x)
    turn = lambda t: F.pmod(t / (2 * np.pi), F.lit(1.0))
    of = [(w * w + z * z - x * x - y * y + 1) / 2, turn(a + b), turn(a - b)]
    part = [F.greatest(F.lit(0), F.least(F.floor(u * 2**level), F.lit(2**level - 1))).cast("long") for u in of]
    return sum((F.shiftleft(F.shiftright(p, i).bitwiseAND(1), 3 * i + 2 - k) for i in range(level) for k, p in enumerate(part)), F.lit(0).cast("long"))


def middles(cells: np.ndarray, level: int) -> np.ndarray:
    """The rotations at the middles of cells, a quaternion each."""
    bits = [sum(((cells >> (3 * i + 2 - k) & 1) << i for i in range(level)), np.zeros(len(cells), dtype=np.int64)) for k in range(3)]
    height, s, t = ((b + 0.5) / 2**level for b in bits)
    big, small, a, b = np.sqrt(height), np.sqrt(1 - height), np.pi * (s + t), np.pi * (s - t)
    return np.stack([big * np.cos(a), small * np.cos(b), small * np.sin(b), big * np.sin(a)], axis=1)


def rotation_table(spark: SparkSession, level: int) -> DataFrame:
    """cell, parent, w, x, y, z: the rotation at the middle of each of the 8^level cells."""
    cells = spark.range(8**level).withColumnRenamed("id", "cell")

    def middle(k: int) -> Column:
        bits = (F.shiftleft(F.shiftright("cell", 3 * i + 2 - k).bitwiseAND(1), i) for i in range(level))
        return (sum(bits, F.lit(0)) + 0.5) / 2**level

    height, s, t = middle(0), 2 * np.pi * middle(1), 2 * np.pi * middle(2)
    big, small = F.sqrt(height), F.sqrt(1 - height)
    a, b = (s + t) / 2, (s - t) / 2
    return cells.select("cell", F.expr("cell div 8").alias("parent"), (big * F.cos(a)).alias("w"), (small * F.cos(b)).alias("x"), (small * F.sin(b)).alias("y"), (big * F.sin(a)).alias("z"))


def cells_of(quats: np.ndarray, level: int) -> np.ndarray:
    """``cell_of`` for an array of quaternions."""
    w, x, y, z = np.asarray(quats).T
    a, b = np.arctan2(z, w), np.arctan2(y, x)
    of = [(w * w + z * z - x * x - y * y + 1) / 2, (a + b) / (2 * np.pi) % 1, (a - b) / (2 * np.pi) % 1]
    part = [np.clip(np.floor(u * 2**level), 0, 2**level - 1).astype(np.int64) for u in of]
    return sum(((p >> i & 1) << (3 * i + 2 - k) for i in range(level) for k, p in enumerate(part)), np.zeros(len(w), dtype=np.int64))


class Tree:
    """Runs of sorted orientations: for each level, from ``top`` to the finest, where each cell that isn't empty begins, and the place of its orientation next to its middle."""

    def __init__(self, quats: np.ndarray) -> None:
        n = len(quats)
        deepest = 1
        while 8 ** (deepest + 1) * LEAF <= n:
            deepest += 1
        cells = cells_of(quats, deepest)
        self.order = np.argsort(cells, kind="stable")
        cells, sorted_ = cells[self.order], quats[self.order]
        self.top = 1 if n < 4096 else 2
        self.n = n
        self.starts, self.reps = [], []
        for level in range(min(self.top, deepest), deepest + 1):
            own = cells >> 3 * (deepest - level)
            first = np.nonzero(np.diff(own, prepend=-1))[0]
            off = -np.abs((middles(own, level) * sorted_).sum(1))
            self.starts.append(first)
            self.reps.append(np.lexsort((off, own))[first])

    def runs(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        first = self.starts[level]
        return first, np.append(first[1:], self.n)


def measure(spark: SparkSession, volume: np.ndarray, quats: np.ndarray, det: np.ndarray, tree: Tree, batch: int) -> tuple[list[np.ndarray], tuple[float, float, float]]:
    """For each level and cell, how far slices of its orientations lie from that of its middle one, at most; and number, sum and sum of squares of all slices' values.

    A task makes the slices of a cell of the top level, in blocks; it keeps one slice for each level beside the block.
    """
    shared = spark.sparkContext.broadcast((volume, quats[tree.order], det, tree.starts, tree.reps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, quats, det, starts, reps = shared.value
        for b in batches:
            for a, z in zip(b.column("a").to_pylist(), b.column("z").to_pylist(), strict=True):
                own = [s[np.searchsorted(s, a) : np.searchsorted(s, z)] for s in starts]
                far = [np.zeros(len(s)) for s in own]
                kept: list = [None] * len(own)
                sums = np.zeros(3)
                for at in range(a, z, batch):
                    end = min(at + batch, z)
                    rows = matching._slices(volume, quats, det, at, end)
                    sums += rows.size, rows.sum(), (rows * rows).sum()
                    for l, s in enumerate(own):
                        for c in range(np.searchsorted(s, at, "right") - 1, np.searchsorted(s, end)):
                            lo, hi = max(s[c], at), min(s[c + 1] if c + 1 < len(s) else z, end)
                            if s[c] >= at:
                                mid = reps[l][np.searchsorted(starts[l], s[c])]
                                kept[l] = rows[mid - at] if at <= mid < end else matching._slices(volume, quats, det, mid, mid + 1)[0]
                            off = rows[lo - at : hi - at] - kept[l]
                            far[l][c] = max(far[l][c], np.sqrt((off * off).sum(1).max()))
                cols = [np.repeat(np.arange(len(own)), [len(s) for s in own]), np.concatenate(own), np.concatenate(far)]
                each = np.zeros((3, len(cols[0])))
                each[:, 0] = sums
                yield pa.record_batch([*map(pa.array, cols), *map(pa.array, each)], names=["level", "first", "far", "n", "s", "ss"])

    a, z = tree.runs(0)
    tops = spark.createDataFrame([(int(i), int(j)) for i, j in zip(a, z, strict=True)], "a long, z long").repartition(len(a))
    got = tops.mapInArrow(run, "level long, first long, far double, n double, s double, ss double").toPandas()  # a row for each cell: fewer than orientations
    far = [got[got.level == l].sort_values("first").far.to_numpy() for l in range(len(tree.starts))]
    return far, tuple(float(got[c].sum()) for c in ("n", "s", "ss"))


def match_nested(images: DataFrame, volume: np.ndarray, quats: np.ndarray, det: np.ndarray, scale: str = "global", batch: int = 1000) -> DataFrame:
    """``matching.match_model``'s rows, and compared: how often an image was compared with a slice. Whole cells are left out where the triangle inequality allows it.

    Cells' radii are measured once on the executors, together with the sums that the global scale needs; so the result is that
    of the full search but for rounding, ties by the lower orientation. Images near the model meet few cells, others more, up to all.
    ``scale`` is 'global' or 'none'. No images or no orientations give no rows.
    """
    if scale not in ("global", "none"):
        raise ValueError(f"scale is 'global' or 'none', not {scale!r}")
    spark = images.sparkSession
    quats = np.asarray(quats, dtype=np.float64).reshape(-1, 4)
    schema = "image_id long, q array<double>, distance double, data array<double>, compared long"
    std = matching.std_of(images) if len(quats) else None
    if std is None:
        return spark.createDataFrame([], schema)
    pixels = det.shape[1]
    tree = Tree(quats)
    far, (n, s, ss) = measure(spark, volume, quats, det, tree, max(1, min(batch, matching.CHUNK_VALUES // pixels)))
    own = np.sqrt(max(0.0, ss / n - (s / n) ** 2))
    factor = std / own if scale == "global" and own else 1.0
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, volume, quats[tree.order], det, factor, tree, [f * factor for f in far]))
    most = max(1, matching.CHUNK_VALUES // pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                t = b.slice(at, most)
                place, least, compared = search(shared.value, matching._wide(t.column(1), t.num_rows))
                q = pa.array(list(shared.value[2][place]), pa.list_(pa.float64()))
                yield pa.record_batch([t.column(0), q, pa.array(least), t.column(1), pa.array(compared)], names=["image_id", "q", "distance", "data", "compared"])

    return images.select("image_id", F.col("data").cast("array<double>").alias("data")).mapInArrow(run, schema)


_made: dict[str, dict[int, np.ndarray]] = {}


def _slices_at(model: tuple, places: np.ndarray) -> np.ndarray:
    """Scaled slices at places of the sorted orientations; a worker keeps as many as matching.HELD_VALUES allows."""
    name, volume, quats, det, factor = model[:5]
    if name not in _made:
        _made.clear()
    kept = _made.setdefault(name, {})
    new = [p for p in places.tolist() if p not in kept]
    fresh = dict(zip(new, factor * matching._slices(volume, quats[new], det, 0, len(new)), strict=True)) if new else {}
    if (len(kept) + len(new)) * det.shape[1] <= matching.HELD_VALUES:
        kept.update(fresh)
    return np.stack([fresh[p] if p in fresh else kept[p] for p in places.tolist()])


def search(model: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each image: the place of the nearest orientation (sorted), its squared distance, and how many slices were compared."""
    tree, far = model[5:]
    own = (x * x).sum(1)
    best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    compared = np.zeros(len(x), dtype=np.int64)

    def meet(who: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = _slices_at(model, places)
        size = own[who, None] + (rows * rows).sum(1)
        d = np.maximum(size - 2 * x[who] @ rows.T, 0)
        compared[who] += len(places)
        number = tree.order[places]
        for j in range(len(places)):
            near = (d[:, j] < best[who]) | ((d[:, j] == best[who]) & (number[j] < tree.order[at[who]]))
            best[who[near]], at[who[near]] = d[near, j], places[j]
        return d, size * SLACK

    def open_(who: np.ndarray, d: np.ndarray, off: np.ndarray, radius: np.ndarray) -> np.ndarray:
        low = np.maximum(np.sqrt(np.maximum(d - off, 0)) - radius * (1 + SLACK), 0)
        return low * low <= best[who, None] + off

    def down(level: int, cell: int, who: np.ndarray, d: np.ndarray, off: np.ndarray, probe: bool) -> None:
        """The cell's middle orientation has been met by ``who`` at ``d``. A probe follows the nearest child only, so that all images have a near slice first."""
        if not probe:
            keep = open_(who, d[:, None], off[:, None], far[level][cell : cell + 1])[:, 0]
            who, d, off = who[keep], d[keep], off[keep]
        if not len(who):
            return
        first, end = (int(v[cell]) for v in tree.runs(level))
        if level + 1 == len(tree.starts):
            for a in range(first, end if end - first > 1 else first, 1024):
                meet(who, np.arange(a, min(a + 1024, end)))
            return
        s = tree.starts[level + 1]
        inner = np.arange(np.searchsorted(s, first), np.searchsorted(s, end))
        reps = tree.reps[level + 1][inner]
        ds, offs = (d[:, None], off[:, None]) if reps.tolist() == [tree.reps[level][cell]] else meet(who, reps)
        for j in np.argsort(ds.min(0), kind="stable"):
            mine = ds.argmin(1) == j if probe else slice(None)
            down(level + 1, int(inner[j]), who[mine], ds[mine, j], offs[mine, j], probe)

    every = np.arange(len(x))
    ds, offs = meet(every, tree.reps[0])
    nearest = ds.argmin(1)
    for probe in (True, False):
        for j in range(ds.shape[1]):
            mine = nearest == j if probe else slice(None)
            down(0, j, every[mine], ds[mine, j], offs[mine, j], probe)
    return at, best, compared
