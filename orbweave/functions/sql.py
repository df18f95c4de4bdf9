"""The transforms as functions of Spark SQL: ``register(spark)``, then call them by name in ``spark.sql``.

* ``volume_at(data, h, k, l)``: array of (re, im), the transform of a cube (flattened, origin in the middle) at points in radians.
* ``grid_points(v, h, k, l, n)``: array of (re, im) of length n^3, values at points brought to a cube of side n, the adjoint of it.
* ``fourier_shells(a, b, most, spacing)``: a table function, (shell, r, fsc) of two cubes; use it with LATERAL.

Arrow brings whole batches of rows to them; points that repeat from row to row are transformed side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from ..operators import kernels

_PAIR = "array<struct<re double, im double>>"


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    return [None if not x.is_valid else np.asarray(x.values, dtype=np.float64) for x in column]


def _complex(rows: list[np.ndarray | None]) -> pa.Array:
    """Rows of complex values as lists of structs; null where an argument is."""
    kind = pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())]))
    size = [0 if x is None else x.size for x in rows]
    flat = np.concatenate([x.ravel() for x in rows if x is not None] or [np.zeros(0, dtype=complex)])
    offsets = pa.array([None if x is None else o for x, o in zip(rows, np.cumsum([0, *size[:-1]]).tolist(), strict=True)] + [sum(size)], pa.int32()) if rows else pa.array([0], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat.real)), pa.array(np.ascontiguousarray(flat.imag))], ["re", "im"]), type=kind)


def _volume_at(data: pa.Array, h: pa.Array, k: pa.Array, l: pa.Array) -> pa.Array:
    out = []
    for row in zip(*map(_lists, (data, h, k, l)), strict=True):
        if any(x is None for x in row):
            out.append(None)
            continue
        n = round(row[0].size ** (1 / 3))
        vol = row[0].reshape(n, n, n)
        out.append(kernels.GriddedNufft(n).type2(vol, *row[1:]) if n >= kernels.GRIDDING_FROM else kernels.nufft2(vol, *row[1:]))
    return _complex(out)


def _grid_points(v: pa.Array, h: pa.Array, k: pa.Array, l: pa.Array, n: pa.Array) -> pa.Array:
    out = []
    for *row, side in zip(*map(_lists, (v, h, k, l)), n.to_pylist(), strict=True):
        if side is None or any(x is None for x in row):
            out.append(None)
            continue
        out.append(kernels.GriddedNufft(side).type1(row[0].astype(complex), *row[1:]) if side >= kernels.GRIDDING_FROM else kernels.nufft1(row[0].astype(complex), *row[1:], side))
    return _complex(out)


class _FourierShells:
    """One pair of cubes at a time; shells are open at both ends."""

    def eval(self, a: list, b: list, most: float, spacing: float) -> Iterator[tuple[int, float, float | None]]:
        if a is None or b is None:
            return
        n = round(len(a) ** (1 / 3))
        f, g = (np.fft.fftshift(np.fft.fftn(np.array(x, dtype=float).reshape(n, n, n))) for x in (a, b))
        s = np.arange(n) * (2 * most / (n - 1)) - most
        at = np.sqrt(s[:, None, None] ** 2 + s[:, None] ** 2 + s**2)
        shell = np.floor(at / spacing).astype(int)
        inside = (at > shell * spacing) & (at < (shell + 1) * spacing) & (shell * spacing < most)
        for i in np.unique(shell[inside]).tolist():
            x, y = f[inside & (shell == i)], g[inside & (shell == i)]
            power = float(np.sqrt((np.abs(x) ** 2).sum() * (np.abs(y) ** 2).sum()))
            yield i, (i + 0.5) * spacing, float((x * y.conj()).real.sum()) / power if power else None


def register(spark: SparkSession) -> None:
    spark.udf.register("volume_at", arrow_udf(_volume_at, _PAIR))
    spark.udf.register("grid_points", arrow_udf(_grid_points, _PAIR))
    spark.udtf.register("fourier_shells", udtf(_FourierShells, returnType="shell int, r double, fsc double"))
