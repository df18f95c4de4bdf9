"""Volumes cut into slabs: transforms, stencils, phase retrieval and conjugate gradients in which no task holds a volume.

A volume of n values a side is rows of a table, one for each slab of ``thick`` planes along its first axis (vol_id, block, data: thick x n x n
values). A transform works on the two axes that lie within a slab, cuts the slab into tiles, and one exchange brings the tiles of
each pencil (all planes, ``thick`` lines of the second axis) together, where the third axis is transformed. What happens at
frequencies happens there, and a second exchange turns the pencils back into slabs. A stencil sends each slab the planes next to it.

Rows of one group are equally long, so an Arrow batch of many groups is one array, and many small volumes go through the same
code as a few large ones. Iterations write their state every few steps: a lost executor costs those, and plans stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Values of a slab, at most (but for a single plane).
SLAB_VALUES = 1 << 18
#: Steps of an iteration between two writes of its state.
WRITE_EVERY = 2
#: Bytes of rows that a task takes at once, about.
TAKE = 4 << 20

ROWS = "vol_id long, block int, part int, data binary"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: The table that a table was mapped from, and by what.
_MAPPED: WeakKeyDictionary[DataFrame, tuple[DataFrame, tuple[Run, ...]]] = WeakKeyDictionary()


def _map(rows: DataFrame, run: Run, schema: str = ROWS) -> DataFrame:
    """rows.mapInArrow(run, schema), in the same process as the steps that made the rows, if those come from here too: every mapInArrow of a
    chain is a Python process of its own in each running task, and these outweigh what they hold."""
    source, before = _MAPPED.get(rows, (rows, ()))
    runs = (*before, run)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in runs:
            batches = one(batches)
        return batches

    out = source.mapInArrow(chain, schema)
    _MAPPED[out] = (source, runs)
    return out


def thickness(n: int) -> int:
    """Planes of a slab: the most that divide n and stay under SLAB_VALUES."""
    return max(t for t in range(1, n + 1) if n % t == 0 and (t == 1 or t * n * n <= SLAB_VALUES))


def _rows(vol: np.ndarray, block: np.ndarray, part: np.ndarray | int, data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of equally long data, in batches that Arrow's 32-bit offsets can hold."""
    flat = np.ascontiguousarray(data).reshape(len(vol), -1).view(np.uint8)
    part = np.broadcast_to(np.asarray(part), (len(vol),))
    width = flat.shape[1]
    step = max(1, TAKE // max(1, width))
    for a in range(0, len(vol), step):
        own = flat[a : a + step]
        offsets = np.arange(len(own) + 1, dtype=np.int32) * width
        held = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(own))])
        cols = [pa.array(vol[a : a + step], pa.int64()), pa.array(block[a : a + step], pa.int32()), pa.array(part[a : a + step], pa.int32()), held]
        yield pa.record_batch(cols, names=["vol_id", "block", "part", "data"])


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, one after another."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vol_id, block, bytes of the group) for groups of ``size`` rows each, which come one after another."""
    held: list[pa.RecordBatch] = []
    n = weight = 0

    def close() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        nonlocal held, n, weight
        table = pa.Table.from_batches(held).combine_chunks()
        full = len(table) // size * size
        if full:
            own = table.slice(0, full).to_batches()[0]
            yield own.column(0).to_numpy()[::size], own.column(1).to_numpy()[::size], _bytes(own.column(3)).reshape(full // size, -1)
        held = table.slice(full).to_batches()
        n, weight = len(table) - full, 0

    for b in batches:
        if b.num_rows:
            held.append(b)
            n, weight = n + b.num_rows, weight + b.nbytes
            if n >= size and weight >= TAKE:
                yield from close()
    if n >= size:
        yield from close()
    if n:
        raise ValueError(f"{n} rows are left over: a volume has too few or too many slabs")


def _exchange(rows: DataFrame, others: list[DataFrame], tiles: int) -> DataFrame:
    """Tiles and the rows that go with them, together by volume and block and in order."""
    for c, other in enumerate(others):
        rows = rows.unionByName(other.select("vol_id", "block", F.lit(tiles + c).alias("part"), "data"))
    return rows.repartition("vol_id", "block").sortWithinPartitions("vol_id", "block", "part")


def written(rows: DataFrame) -> DataFrame:
    from ..sources.tables import scratch

    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cut(volumes: DataFrame, n: int, thick: int) -> DataFrame:
    """Slabs of wide volumes (vol_id, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(b.num_rows * (n // thick), -1)
            yield from _rows(np.repeat(b.column(0).to_numpy(), n // thick), np.tile(np.arange(n // thick), b.num_rows), 0, x)

    return _map(volumes.select(F.col("vol_id").cast("long"), F.col("data").cast("array<double>")), run)


def voxels(slabs: DataFrame, n: int, thick: int, *names: str, pencils: bool = False, complex_: bool = False) -> DataFrame:
    """vol_id, i, j, k and the values of slabs or pencils as long rows; of complex ones the real and imaginary parts."""
    shape = (n, thick, n) if pencils else (thick, n, n)
    at = np.indices(shape).reshape(3, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, step := max(1, (1 << 16) // at.shape[1])):
                own = b.slice(a, step)
                x = _bytes(own.column(3)).view("<c16" if complex_ else "<f8").reshape(own.num_rows, -1)
                first = np.repeat(own.column(1).to_numpy() * thick, at.shape[1])
                index = [np.tile(z, own.num_rows) for z in at]
                index[1 if pencils else 0] = index[1 if pencils else 0] + first
                values = [x.real.ravel(), x.imag.ravel()] if complex_ else [x.ravel()]
                yield pa.record_batch([pa.array(np.repeat(own.column(0).to_numpy(), at.shape[1])), *(pa.array(z.astype(np.int32)) for z in index), *map(pa.array, values)], names=["vol_id", "i", "j", "k", *names])

    return _map(slabs, run, "vol_id long, i int, j int, k int, " + ", ".join(f"{x} double" for x in names))


AtFrequency = Callable[[np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray]
InSpace = Callable[[np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray]


def forward(slabs: DataFrame, n: int, thick: int, m: int | None = None, then: AtFrequency | None = None, others: list[DataFrame] | None = None, back: bool = False) -> DataFrame:
    """Pencils of the transform of slabs, on a grid of m (n) a side padded with zeros: vol_id, block, data (m x thick x m complex values).

    then(f, block, others): what to make of the pencils f (groups, m, thick, m); block: their places. others: tables of pencils that go
    with them (vol_id, block, data of doubles). back: the tiles of slabs, transformed back along the first axis, that ``backward`` takes.
    """
    m, others = m or n, others or []
    tiles, more = n // thick, len(others)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            for a in range(0, b.num_rows, step := max(1, TAKE // (16 * thick * m * m))):
                own = b.slice(a, step)
                x = _bytes(own.column(3)).view("<f8").reshape(own.num_rows, thick, n, n)
                f = np.fft.fft2(x, s=(m, m)).reshape(own.num_rows, thick, m // thick, thick, m).transpose(0, 2, 1, 3, 4)
                yield from _rows(np.repeat(own.column(0).to_numpy(), m // thick), np.tile(np.arange(m // thick), own.num_rows), np.repeat(own.column(1).to_numpy(), m // thick), f)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vol, block, raw in _groups(batches, tiles + more):
            own = 16 * n * thick * m
            f = np.ascontiguousarray(raw[:, :own]).view("<c16").reshape(len(vol), n, thick, m)
            f = np.fft.fft(f, n=m, axis=1)
            if then:
                width = (raw.shape[1] - own) // max(1, more)
                f = then(f, block, [np.ascontiguousarray(raw[:, own + c * width : own + (c + 1) * width]).view("<f8") for c in range(more)])
            if not back:
                yield from _rows(vol, block, 0, f)
                continue
            x = np.fft.ifft(f, axis=1)[:, :n].reshape(len(vol) * tiles, -1)
            yield from _rows(np.repeat(vol, tiles), np.tile(np.arange(tiles), len(vol)), np.repeat(block, tiles), x)

    return _map(_exchange(_map(slabs, within), others, tiles), across)


def backward(tiles: DataFrame, n: int, thick: int, m: int | None = None, then: InSpace | None = None, others: list[DataFrame] | None = None) -> DataFrame:
    """Slabs (real parts) from the tiles of ``forward(..., back=True)``. then(x, block, others): what to make of the slabs x (groups, thick, n, n)."""
    m, others = m or n, others or []
    more = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vol, block, raw in _groups(batches, m // thick + more):
            own = 16 * thick * m * m
            x = np.ascontiguousarray(raw[:, :own]).view("<c16").reshape(len(vol), m // thick, thick, thick, m).transpose(0, 2, 1, 3, 4)
            x = np.fft.ifft2(x.reshape(len(vol), thick, m, m)).real[:, :, :n, :n]
            if then:
                x = then(x, block, [np.ascontiguousarray(raw[:, own + c * 8 * thick * n * n :][:, : 8 * thick * n * n]).view("<f8").reshape(x.shape) for c in range(more)])
            yield from _rows(vol, block, 0, np.asarray(x, dtype="<f8"))

    return _map(_exchange(tiles, others, m // thick), run)


def pencils_of(volume: np.ndarray, thick: int) -> AtFrequency:
    """Multiplies frequencies by a small volume that every task may hold; a large one is a table of pencils."""
    n = volume.shape[0]
    parts = volume.reshape(n, n // thick, thick, n).transpose(1, 0, 2, 3)
    return lambda f, block, _: f * parts[block]


def convolve(slabs: DataFrame, kernel_f: np.ndarray | DataFrame, n: int, thick: int) -> DataFrame:
    """The product of the normal matrix with slabs: their convolution on a grid twice as wide. kernel_f: the kernel's transform, as an array or as
    pencils of its own (real and imaginary parts one after another)."""
    m = 2 * n
    if isinstance(kernel_f, np.ndarray):
        return backward(forward(slabs, n, thick, m, pencils_of(kernel_f, thick), back=True), n, thick, m)

    def times(f, block, others):
        g = others[0].reshape(len(f), 2, *f.shape[1:])
        return f * (g[:, 0] + 1j * g[:, 1])

    return backward(forward(slabs, n, thick, m, times, [kernel_f], back=True), n, thick, m)


def fourier_reg(slabs: DataFrame, outside: np.ndarray, n: int, thick: int) -> DataFrame:
    """What volumes have at frequencies outside the sampled ball (``outside`` centred)."""
    return backward(forward(slabs, n, thick, then=pencils_of(np.fft.ifftshift(outside), thick), back=True), n, thick)


def autocorrelation(slabs: DataFrame, n: int, thick: int) -> DataFrame:
    """|transform back of |transform|^2|: a density's autocorrelation, which is real and even."""
    return backward(forward(slabs, n, thick, then=lambda f, b, o: np.abs(f) ** 2, back=True), n, thick, then=lambda x, b, o: np.abs(x))


# Phase retrieval: origin at index 0.


def _imposed(amplitude: float | None):
    def then(f, block, others):
        own = others[0].reshape(f.shape) if others else amplitude
        out = own * np.exp(1j * np.angle(f))
        first = block == 0
        out[first, 0, 0, 0] = f[first, 0, 0, 0]  # the origin is not measured
        return out

    return then


def step(rho: DataFrame, n: int, thick: int, amplitude: float | DataFrame, support: DataFrame | None = None, beta: float | None = None, most: float = np.inf) -> DataFrame:
    """Slabs after one step: error reduction, or hybrid with ``beta``. amplitude: a number, or a table of pencils; support: slabs of 0 and 1 (none: everything)."""

    everything = support is None

    def update(new, block, others):
        good = new > 0 if everything else (others[1] > 0) & (new > 0)
        if beta is None:
            return np.where(new > most, most, np.where(good, new, 0))
        out = np.where(good, new, others[0] - beta * new)
        return np.where(new > most, out + 2 * beta * new - most, out)

    table = isinstance(amplitude, DataFrame)
    tiles = forward(rho, n, thick, then=_imposed(None if table else amplitude), others=[amplitude] if table else [], back=True)
    return backward(tiles, n, thick, then=update, others=[rho, *([support] if support is not None else [])])


_EDGE = {"wrap": lambda i, n: i % n, "reflect": lambda i, n: (lambda j: j if j < n else 2 * n - 1 - j)(i % (2 * n)), "constant": lambda i, n: i if 0 <= i < n else -1}


def gauss(slabs: DataFrame, n: int, thick: int, sigma: float, mode: str, truncate: float = 4.0, size: bool = False) -> DataFrame:
    """Separable Gaussian of slabs (of their sizes). Each slab gets the planes within the radius of its own from other slabs, in one exchange."""
    w = kernels.gauss_weights(sigma, truncate)
    radius, blocks = len(w) // 2, n // thick
    wants = [[_EDGE[mode](i, n) for i in range(b * thick - radius, (b + 1) * thick + radius)] for b in range(blocks)]
    sends = [[(b, p) for b in range(blocks) for p in sorted(set(wants[b])) if p >= 0 and p // thick == own] for own in range(blocks)]
    counts = {len({p for p in x if p >= 0}) for x in wants}

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            vol, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = _bytes(b.column(3)).view("<f8").reshape(b.num_rows, thick, n, n)
            x = np.abs(x) if size else x
            for own in np.unique(block).tolist():
                at = np.flatnonzero(block == own)
                to, plane = np.array(sends[own]).T
                yield from _rows(np.repeat(vol[at], len(to)), np.tile(to, len(at)), np.tile(plane, len(at)), x[at][:, plane - own * thick])

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # planes of a block come in order; blocks at an edge may have fewer
        for vol, block, raw in _groups(batches, counts.copy().pop()) if len(counts) == 1 else _ragged(batches, [len({p for p in x if p >= 0}) for x in wants]):
            for own in np.unique(block).tolist():
                at = np.flatnonzero(block == own)
                have = sorted({p for p in wants[own] if p >= 0})
                x = raw[at] if isinstance(raw, np.ndarray) else np.stack([raw[i] for i in at])
                x = np.ascontiguousarray(x).view("<f8").reshape(len(at), len(have), n, n)
                x = np.concatenate([x, np.zeros((len(at), 1, n, n))], axis=1)
                x = x[:, [have.index(p) if p >= 0 else len(have) for p in wants[own]]]
                x = sum(v * x[:, i : i + thick] for i, v in enumerate(w))
                for axis in (2, 3):
                    pad = [(0, 0)] * 4
                    pad[axis] = (radius, radius)
                    wide = np.pad(x, pad, mode=kernels._PAD[mode])
                    x = sum(v * np.take(wide, range(i, i + n), axis=axis) for i, v in enumerate(w))
                yield from _rows(vol[at], block[at], 0, x)

    return _map(_exchange(_map(slabs, planes), [], 0), smooth)


def _ragged(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Groups whose number of rows is that of their block."""
    held: list[bytes] = []
    for b in batches:
        for vol, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            held.append(data)
            if len(held) == sizes[block]:
                yield np.array([vol]), np.array([block]), [np.frombuffer(b"".join(held), dtype=np.uint8)]
                held = []


def sums(slabs: DataFrame) -> DataFrame:
    """vol_id, n, s, ss, top: number, sum, sum of squares and largest of the values of each volume."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x = _bytes(b.column(3)).view("<f8").reshape(b.num_rows, -1)
            cols = [np.full(len(x), float(x.shape[1])), x.sum(1), (x * x).sum(1), x.max(1)]
            yield pa.record_batch([b.column(0), *map(pa.array, cols)], names=["vol_id", "n", "s", "ss", "top"])

    parts = _map(slabs, run, "vol_id long, n double, s double, ss double, top double")
    return parts.groupBy("vol_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.max("top").alias("top"))


def shrink_wrap(rho: DataFrame, n: int, thick: int, method: str = "std", weight: float = 1.0, cutoff: float = 0.05, weights: DataFrame | None = None) -> DataFrame:
    """Slabs of 1 within the new support, 0 outside. The level is that of the whole volume, a sum of the slabs' sums; weights: vol_id, weight, if they differ."""
    if method not in ("std", "max"):
        raise ValueError(f"method is 'std' or 'max', not {method!r}")
    smooth = written(gauss(rho, n, thick, 1.0, "wrap", 2.0, size=True))
    if method == "std":
        level = sums(smooth).select("vol_id", F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)))).alias("level"))
    else:
        level = sums(mapped(rho, np.abs)).select("vol_id", (F.col("top") * cutoff).alias("level"))
    level = level.join(weights, "vol_id").withColumn("level", F.col("level") * F.col("weight")) if weights is not None else level.withColumn("level", F.col("level") * weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x = _bytes(b.column(3)).view("<f8").reshape(b.num_rows, -1)
            yield from _rows(b.column(0).to_numpy(), b.column(1).to_numpy(), 0, (x > b.column(4).to_numpy()[:, None]).astype("<f8"))

    return _map(smooth.join(level.select("vol_id", "level"), "vol_id").select("vol_id", "block", "part", "data", "level"), run)


def mapped(slabs: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            yield from _rows(b.column(0).to_numpy(), b.column(1).to_numpy(), 0, fn(_bytes(b.column(3)).view("<f8").reshape(b.num_rows, -1)))

    return _map(slabs, run)


def amplitudes(ac: DataFrame, n: int, thick: int) -> tuple[DataFrame, DataFrame]:
    """(pencils of amplitudes, slabs of the smoothed volume) of autocorrelations with the origin at index n // 2, which comes to index 0."""
    smooth = gauss(mapped(ac, lambda x: np.maximum(x, 0)), n, thick, 1.0, "constant", 2.0)
    rolled = written(roll(smooth, n, thick, n // 2))
    # real amplitudes: the data of a pencil are doubles
    size = forward(rolled, n, thick, then=lambda f, b, o: np.sqrt(np.abs(f)))
    return written(size), rolled


def roll(slabs: DataFrame, n: int, thick: int, by: int) -> DataFrame:
    """Slabs with index ``by`` of every axis brought to index 0: planes change their slab by key, lines and columns within it."""

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x = np.roll(_bytes(b.column(3)).view("<f8").reshape(b.num_rows, thick, n, n), (-by, -by), (2, 3))
            at = (b.column(1).to_numpy()[:, None] * thick + np.arange(thick) - by).ravel() % n
            yield from _rows(np.repeat(b.column(0).to_numpy(), thick), at // thick, at % thick, x.reshape(-1, n * n))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vol, block, raw in _groups(batches, thick):
            yield from _rows(vol, block, 0, raw)

    return _map(_exchange(_map(slabs, planes), [], 0), together)


def retrieve(ac: DataFrame, n: int, thick: int, start: DataFrame, loops: int, n_er: int, n_hio: int, beta: float, method: str = "std", weight: float = 1.0, cutoff: float = 0.05, most: float = np.inf, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(density, support) as slabs, of any number of volumes side by side: loops of error reduction, hybrid steps, error reduction and shrink-wrap, then
    error reduction again. ac: slabs of autocorrelations, origin at n // 2; start: slabs of densities to begin with, origin at index 0, taken
    within the first support."""
    amplitude, smooth = amplitudes(ac, n, thick)
    top = sums(smooth).select("vol_id", (F.col("top") * 0.01).alias("level"))
    quarter = n // 4
    box = np.zeros((n, n, n), dtype=bool)
    box[(slice(quarter, n - quarter),) * 3] = True
    box = np.fft.ifftshift(box).reshape(n // thick, -1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x = _bytes(b.column(3)).view("<f8").reshape(b.num_rows, -1)
            block = b.column(1).to_numpy()
            yield from _rows(b.column(0).to_numpy(), block, 0, ((x > b.column(4).to_numpy()[:, None]) & box[block]).astype("<f8"))

    support = written(_map(smooth.join(top, "vol_id").select("vol_id", "block", "part", "data", "level"), first))
    rho = written(_product(start, support))
    done = 0

    def steps(x: DataFrame, times: int, b: float | None) -> DataFrame:
        nonlocal done
        for _ in range(times):
            x = step(x, n, thick, amplitude, support, b, most)
            done += 1
            x = written(x) if done % WRITE_EVERY == 0 else x
        return x

    for _ in range(loops):
        rho = written(steps(steps(steps(rho, n_er, None), n_hio, beta), n_er, None))
        support = written(shrink_wrap(rho, n, thick, method, weight, cutoff, weights))
    return written(steps(rho, n_er, None)), support


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vol, block, raw in _groups(batches, 2):
            x = np.ascontiguousarray(raw).view("<f8").reshape(len(vol), 2, -1)
            yield from _rows(vol, block, 0, x[:, 0] * x[:, 1])

    return _map(_exchange(a.select("vol_id", "block", F.lit(0).alias("part"), "data"), [b], 1), run)


def normal_product(slabs: DataFrame, kernel_f: np.ndarray | DataFrame, outside: np.ndarray, rlambda: float, flambda: float, n: int, thick: int) -> DataFrame:
    """The regularised normal matrix times slabs: convolution, ridge and what lies outside the sampled ball; summed where the last of them comes back to its slab."""
    tiles = forward(slabs, n, thick, then=pencils_of(np.fft.ifftshift(outside), thick), back=True)
    return backward(tiles, n, thick, then=lambda x, block, others: flambda * x + rlambda * others[0] + others[1], others=[slabs, convolve(slabs, kernel_f, n, thick)])


# Conjugate gradients: x, r, p of a slab lie in one row.


def conjugate_gradient(apply: Callable[[DataFrame], DataFrame], d: DataFrame, n: int, thick: int, steps: int) -> DataFrame:
    """Slabs of x after ``steps`` from zero, of all volumes (members) side by side. apply: slabs to the slabs of the matrix's product with them.

    The scalars of a step come from three sums by volume over its slabs (p.w, r.w, w.w): the next residual's norm follows from them, so a step
    is one product, one exchange that brings w to its slab, and one aggregate.
    """
    width = thick * n * n

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x = _bytes(b.column(3)).view("<f8").reshape(b.num_rows, width)
            yield from _rows(b.column(0).to_numpy(), b.column(1).to_numpy(), 0, np.concatenate([np.zeros_like(x), x, x], axis=1))

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vol, block, raw in _groups(batches, 2):
            x, r, p, w = np.ascontiguousarray(raw).view("<f8").reshape(len(vol), 4, width).transpose(1, 0, 2)
            of = [(a * b).sum(1) for a, b in ((r, r), (p, w), (r, w), (w, w))]
            for b in _rows(vol, block, 0, raw):
                at, of_ = b.num_rows, [z for z in of]
                yield pa.record_batch([*b.columns, *(pa.array(z[:at]) for z in of_)], names=[*b.schema.names, "rr", "pw", "rw", "ww"])
                of = [z[at:] for z in of]

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            x, r, p, w = _bytes(b.column(3)).view("<f8").reshape(b.num_rows, 4, width).transpose(1, 0, 2)
            a, beta = b.column(4).to_numpy()[:, None], b.column(5).to_numpy()[:, None]
            r = r - a * w
            yield from _rows(b.column(0).to_numpy(), b.column(1).to_numpy(), 0, np.concatenate([x + a * p, r, r + beta * p], axis=1))

    def last(i: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b for b in batches if b.num_rows):
                yield from _rows(b.column(0).to_numpy(), b.column(1).to_numpy(), 0, _bytes(b.column(3)).view("<f8").reshape(b.num_rows, 3, width)[:, i])

        return run

    now = _map(d, state)
    for nth in range(steps):
        w = apply(_map(now, last(2)))
        both = written(_map(_exchange(now, [w], 1), dots, ROWS + ", rr double, pw double, rw double, ww double"))
        total = both.groupBy("vol_id").agg(*[F.sum(c).alias(c) for c in ("rr", "pw", "rw", "ww")])
        a = F.coalesce(F.try_divide("rr", "pw"), F.lit(0.0))
        total = total.select("vol_id", a.alias("a"), F.coalesce(F.try_divide(F.col("rr") - 2 * a * F.col("rw") + a * a * F.col("ww"), F.col("rr")), F.lit(0.0)).alias("beta"))
        now = _map(both.drop("rr", "pw", "rw", "ww").join(total, "vol_id").select("vol_id", "block", "part", "data", "a", "beta"), advance)
        now = written(now) if nth % WRITE_EVERY else now
    return _map(now, last(0))
