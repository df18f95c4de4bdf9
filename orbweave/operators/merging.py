"""From oriented images to the autocorrelation volume.

The normal equations are data-parallel: every batch of images adds its points to a fixed-size right-hand side and kernel grid,
tasks hand on one grid each in slabs, and slabs are summed by key in two levels, as a stream: a task holds one slab at a time,
and of a key the second level sees at most FANS slabs, however many tasks the images had. Members of an ensemble (a shard of images, a pair of regularisers) are solved side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Groups of tasks whose slabs are summed side by side.
FANS = 64


def lambda_grid(spark, members: int, n_values: int, m: int) -> DataFrame:
    """member, rlambda, flambda: regularisers spread around their defaults by powers of 2 and 10."""
    k = spark.range(members).select(F.col("id").cast("int").alias("member"))
    half = members / 2
    return k.select(
        "member",
        (F.lit(m**3 / n_values) * F.pow(F.lit(2.0), F.col("member") - half)).alias("rlambda"),
        (F.lit(1e5) * F.pow(F.lit(10.0), (F.col("member") - members // 2).cast("double"))).alias("flambda"),
    )


def select_first(solved: DataFrame) -> DataFrame:
    """generation 0: of the members whose solution is at least of mean norm, the one with the strongest regulariser."""
    mean = solved.agg(F.avg("v1").alias("mean"))
    good = solved.crossJoin(F.broadcast(mean)).where("v1 >= mean")
    return good.agg(F.expr("max_by(member, struct(rlambda, -member))").alias("member"))


def select_corner(solved: DataFrame) -> DataFrame:
    """Later generations: the least sum of solution norm and residual, the lower member on ties."""
    return solved.agg(F.expr("min_by(member, struct(v1 + v2, member))").alias("member"))


def _grids(det: np.ndarray, n: int):
    """Partial right-hand sides (side n) and kernels (side 2n) of each member, one of each per task."""
    big = 2 * n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rhs, ker = {}, {}
        points = kernels.GriddedNufft(big) if big >= kernels.GRIDDING_FROM else None
        small = kernels.GriddedNufft(n) if big >= kernels.GRIDDING_FROM else None
        fan = TaskContext.get().partitionId() % FANS
        for b in batches:
            for member, q, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, k, l = kernels.matrix_of(np.array(q)).T @ det  # the inverse rotation
                v = np.array(data, dtype=np.complex128)
                one = np.ones(len(v), dtype=np.complex128)
                r = small.type1(v, h, k, l) if small else kernels.nufft1(v, h, k, l, n)
                g = points.type1(one, h, k, l) if points else kernels.nufft1(one, h, k, l, big)
                rhs[member] = rhs.get(member, 0) + r.real
                ker[member] = ker.get(member, 0) + g.real
        for part, grids in (("rhs", rhs), ("kernel", ker)):
            for member, g in grids.items():
                for i, slab in enumerate(g):
                    yield pa.record_batch(
                        [pa.array([member], pa.int32()), pa.array([part]), pa.array([i], pa.int32()), pa.array([fan], pa.int32()), pa.array([slab.ravel()], pa.list_(pa.float64()))],
                        names=["member", "part", "slab", "fan", "data"],
                    )

    return run


def _add(keys: list[str]):
    """Sums of the slabs of each key, over rows that come sorted by it; a key may run over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, kinds = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if last is not None:
                yield pa.record_batch([*(pa.array([k], t) for k, t in zip(last, kinds, strict=True)), pa.array([total], pa.list_(pa.float64()))], names=[*keys, "data"])

        for b in batches:
            kinds = [b.schema.field(k).type for k in keys]
            for key, slab in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column("data"), strict=True):
                values = np.asarray(slab.values)
                if key == last:
                    total = total + values
                else:
                    yield from done()
                    last, total = key, values
        yield from done()

    return run


def summed(slabs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the sum of its arrays ``data``."""
    kinds = dict(slabs.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "data array<double>"])
    parts = int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slabs.select(*keys, "data").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_add(keys), schema)


def normal_grids(images: DataFrame, det: np.ndarray, n: int) -> DataFrame:
    """member, part (rhs or kernel), slab, data. images: member, q (array w, x, y, z), data; det: 3 x pixels in radians."""
    parts = images.select(F.col("member").cast("int"), "q", "data").mapInArrow(_grids(det, n), "member int, part string, slab int, fan int, data array<double>")
    return summed(summed(parts, ["member", "part", "slab", "fan"]), ["member", "part", "slab"])


def kernel_transform(kernel: np.ndarray) -> np.ndarray:
    """For a kernel on the centred grid of side 2n: its transform with the origin at index 0."""
    return np.fft.fftn(np.fft.ifftshift(kernel))


def normal_operator(kernel_f, support, outside, rlambda, flambda, alambda=1.0):
    def apply(u):
        return alambda * kernels.convolve(u, kernel_f, support) + rlambda * u + flambda * kernels.fourier_reg(u, support, outside)

    return apply


def outside_ball(n: int, oversampling: float) -> np.ndarray:
    q = np.linspace(-math.pi, math.pi, n)
    h, k, l = np.meshgrid(q, q, q, indexing="ij")
    return np.round(np.sqrt(h * h + k * k + l * l), 4) > round(math.pi / oversampling, 4)


def constraints(estimate: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, support) that a solution starts from: nothing known in generation 0."""
    if estimate is None:
        return np.zeros((n, n, n)), np.ones((n, n, n))
    support = (kernels.gauss(estimate, 0.5, "reflect") > 1e-12).astype(float)
    return estimate * support, support


def _solve(n: int, estimate: np.ndarray | None, oversampling: float, most: int):
    def run(t: pa.Table) -> pa.Table:
        slabs = {p: [None] * (n if p == "rhs" else 2 * n) for p in ("rhs", "kernel")}
        for part, i, data in zip(t.column("part").to_pylist(), t.column("slab").to_pylist(), t.column("data"), strict=True):
            slabs[part][i] = np.asarray(data.values)
        rhs = np.stack(slabs["rhs"]).reshape(n, n, n)
        kernel = np.stack(slabs["kernel"]).reshape((2 * n,) * 3)
        r, f = t.column("rlambda")[0].as_py(), t.column("flambda")[0].as_py()
        x0, support = constraints(estimate, n)
        apply = normal_operator(kernel_transform(kernel), support, outside_ball(n, oversampling), r, f)
        d = rhs * support + r * x0
        begin = float(np.linalg.norm(apply(x0) - d))
        x, steps = kernels.conjugate_gradient(apply, d, x0, most)
        return pa.table({
            "member": t.column("member")[:1], "rlambda": [r], "flambda": [f], "v0": [begin], "v1": [float(np.linalg.norm(x))],
            "v2": [float(np.linalg.norm(apply(x) - d))], "steps": pa.array([steps], pa.int32()), "data": pa.array([x.ravel()], pa.list_(pa.float64())),
        })

    return run


def solve(grids: DataFrame, lambdas: DataFrame, n: int, estimate: np.ndarray | None = None, oversampling: float = 1.0, most: int = 100) -> DataFrame:
    """member, rlambda, flambda, v0 (first residual), v1 (norm), v2 (residual), steps, data: conjugate gradients for each member, one task each.

    A member's input is its summed grids, (n^3 + 8 n^3) values.
    """
    # ``grids`` with a single member serve all regularisers
    both = grids.drop("member").crossJoin(F.broadcast(lambdas)) if grids.select("member").distinct().count() == 1 else grids.join(F.broadcast(lambdas), "member")
    schema = "member int, rlambda double, flambda double, v0 double, v1 double, v2 double, steps int, data array<double>"
    return both.groupBy("member").applyInArrow(_solve(n, estimate, oversampling, most), schema)
