"""Atoms of Protein Data Bank files (fixed columns), the density that they make on a grid, and the one that their diffraction gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Electrons of the common elements; others count as carbon.
ELECTRONS = {"H": 1, "C": 6, "N": 7, "O": 8, "NA": 11, "MG": 12, "P": 15, "S": 16, "CL": 17, "K": 19, "CA": 20, "FE": 26, "ZN": 30}


def parse(lines: DataFrame) -> DataFrame:
    """x, y, z (Angstrom), electrons of the atom records in the column ``value``; other records and broken ones are left out."""
    part = lambda a, n: F.trim(F.substring("value", a, n))
    symbol = F.when(part(77, 2) != "", F.upper(part(77, 2))).otherwise(F.substring(part(13, 4), 1, 1))
    electrons = F.lit(6)
    for name, n in ELECTRONS.items():
        electrons = F.when(symbol == name, n).otherwise(electrons)
    atoms = lines.where(F.col("value").rlike("^(ATOM  |HETATM)")).select(
        *[part(a, 8).try_cast("double").alias(n) for n, a in (("x", 31), ("y", 39), ("z", 47))], electrons.cast("double").alias("electrons")
    )
    return atoms.dropna()


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def density(atoms: DataFrame, n: int, voxel: float, sigma: float, reach: int = 3) -> DataFrame:
    """i, j, k, v: each atom as a Gaussian of width ``sigma`` (in voxels) over the voxels within ``reach`` of its own.

    The atoms' mean lies on the middle voxel n // 2; what falls outside the cube is left out, and empty voxels have no row. Atoms
    are added up voxel by voxel with partial sums, so any number of them will do.
    """
    mean = atoms.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    at = atoms.crossJoin(F.broadcast(mean)).select("electrons", *[((F.col(c) - F.col(f"m{c}")) / voxel + n // 2).alias(c) for c in "xyz"])
    steps = F.array(*[F.lit(s) for s in range(-reach, reach + 1)])
    for c, out in zip("xyz", "ijk", strict=True):
        at = at.withColumn("s", F.explode(steps)).withColumn(out, (F.floor(F.col(c) + 0.5) + F.col("s")).cast("int")).drop("s")
        at = at.where((F.col(out) >= 0) & (F.col(out) < n))
    d2 = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip("ijk", "xyz", strict=True)), F.lit(0.0))
    return at.groupBy("i", "j", "k").agg(F.sum(F.col("electrons") * F.exp(-d2 / (2 * sigma * sigma))).alias("v"))


def diffraction(atoms: DataFrame, n: int, q_max: float) -> DataFrame:
    """slab, part (re or im), data: the field that the atoms, about their mean, scatter on a mesh of n^3 points from -q_max to q_max (radians per unit of length).

    Each task adds up its own atoms; the mesh has a fixed size and is summed in slabs.
    """
    from ..operators import kernels, merging

    mean = atoms.agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])  # one row
    at = atoms.join(F.broadcast(mean)).select("electrons", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])
    step = 2 * q_max / (n - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros((n, n, n), dtype=np.complex128)
        for b in batches:
            e, x, y, z = (c.to_numpy() for c in b.columns)
            field += kernels.nufft1(e.astype(np.complex128), x * step, y * step, z * step, n)
        for part, values in (("re", field.real), ("im", field.imag)):
            yield pa.record_batch([pa.array(range(n), pa.int32()), pa.array([part] * n), pa.array(list(values.reshape(n, -1)))], names=["slab", "part", "data"])

    parts = at.mapInArrow(run, "slab int, part string, data array<double>")
    return merging.summed(parts, ["slab", "part"])


def reference_density(atoms: DataFrame, n: int, q_max: float) -> DataFrame:
    """i, j, k, v: the density whose transform is the atoms' diffraction field, its origin in the middle. n is odd. No atoms give zeros."""
    if n % 2 == 0:
        raise ValueError("the side of the mesh has to be odd, so that it has its origin in the middle")

    def run(t: pa.Table) -> pa.Table:
        field = np.zeros((n, n * n), dtype=np.complex128)
        for slab, part, data in zip(t.column("slab").to_pylist(), t.column("part").to_pylist(), t.column("data"), strict=True):
            field[slab] += np.asarray(data.values) * (1 if part == "re" else 1j)
        v = np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(field.reshape(n, n, n)))).real
        return pa.table({**{c: x.ravel().astype(np.int32) for c, x in zip("ijk", np.indices(v.shape), strict=True)}, "v": v.ravel()})

    slabs = diffraction(atoms, n, q_max)  # 2 n rows of n^2 values
    return slabs.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(run, "i int, j int, k int, v double")
