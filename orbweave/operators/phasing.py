"""From an autocorrelation to a density: single steps over tables of volumes, statistics, and ensembles of whole runs.

Volumes have the origin at index 0 here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

BINS = 200


def initial_support(volumes: DataFrame, quarter: int) -> DataFrame:
    return kernels.map_volumes(volumes, lambda v: {"data": kernels.box_support(v, quarter).astype(float)}, {"data": "array<double>"})


def center_of_mass(voxels: DataFrame, n: int) -> DataFrame:
    """vol_id, si, sj, sk: whole voxels from the origin (halves to even); native, over long volumes."""
    offsets = kernels.half_offsets(n).tolist()

    def place(c: str):
        return F.element_at(F.array(*[F.lit(x) for x in offsets]), F.col(c) + 1)

    size = F.abs("v")
    total = F.sum(size)
    return voxels.groupBy("vol_id").agg(*[F.bround(F.try_divide(F.sum(size * place(c)), total) * n / 2).alias(f"s{c}") for c in "ijk"])


def recenter(voxels: DataFrame, n: int) -> DataFrame:
    """Long volumes rolled so that their centre of mass comes to the origin."""
    at = voxels.join(center_of_mass(voxels, n), "vol_id")
    return at.select("vol_id", *[F.pmod(F.col(c) - F.coalesce(F.col(f"s{c}"), F.lit(0.0)).cast("int"), F.lit(n)).alias(c) for c in "ijk"], "v")


def histogram(voxels: DataFrame, bins: int = BINS) -> DataFrame:
    """vol_id, bin, n of the positive values: equal bins from least to largest, the last one closed; empty bins count 0.

    A volume whose positive values are all equal has them in the middle, as the range is widened by a half each way.
    """
    pos = voxels.where("v > 0")
    ends = pos.groupBy("vol_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ends = ends.select("vol_id", *[F.when(F.col("low") == F.col("high"), F.col(c) + d).otherwise(F.col(c)).alias(c) for c, d in (("low", -0.5), ("high", 0.5))])
    width = (F.col("high") - F.col("low")) / bins
    got = pos.join(ends, "vol_id").select("vol_id", F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = got.groupBy("vol_id", "bin").agg(F.count("*").alias("n"))
    every = ends.select("vol_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, ["vol_id", "bin"], "left").select("vol_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_skew(hist: DataFrame) -> DataFrame:
    """vol_id, skew of the bin counts (population form; null if all are equal)."""
    return hist.groupBy("vol_id").agg(F.skewness("n").alias("skew"))


def least_skew(skews: DataFrame) -> DataFrame:
    return skews.where("skew is not null and not isnan(skew)").agg(F.expr("min_by(vol_id, struct(skew, vol_id))").alias("vol_id"))


def fit_histograms(hist: DataFrame) -> DataFrame:
    """vol_id, height, place, width of a Gaussian through each histogram (bins as unit steps); zeros where the fit fails."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("bin").to_numpy())
        got = kernels.gauss_fit(t.column("bin").to_numpy()[order].astype(float), t.column("n").to_numpy()[order].astype(float))
        return pa.table({"vol_id": t.column("vol_id")[:1], "height": [got[0]], "place": [got[1]], "width": [got[2]]})

    return hist.groupBy("vol_id").applyInArrow(run, "vol_id long, height double, place double, width double")


def ensemble(spark, ac: np.ndarray, members: int, settings, support: np.ndarray | None = None, rho: np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """member, skew, height, width, ac, support, rho: phasing runs with thresholds spread from 0.5, one task each.

    The volume has a fixed size and goes to every task with its function.
    """
    n = ac.shape[0]

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                got = kernels.phase(
                    ac, support, rho, n // 4, settings.n_phase_loops, settings.n_er, settings.n_hio, settings.beta,
                    settings.shrinkwrap, 0.5 + k / members, seed + k, settings.cutoff, settings.density_cap or np.inf,
                )
                positive = got[2][got[2] > 0]
                counts = np.histogram(positive, BINS)[0].astype(float) if len(positive) else np.zeros(BINS)
                spread = counts.std()
                skew = float(((counts - counts.mean()) ** 3).mean() / spread**3) if spread else float("inf")
                height, _, width = kernels.gauss_fit(np.arange(BINS) + 0.5, counts)
                yield pa.record_batch(
                    [pa.array([k], pa.int32()), *[pa.array([x], pa.float64()) for x in (skew, height, width)], *[pa.array([x.astype(float).ravel()]) for x in got]],
                    names=["member", "skew", "height", "width", "ac", "support", "rho"],
                )

    schema = "member int, skew double, height double, width double, ac array<double>, support array<double>, rho array<double>"
    return spark.range(0, members, 1, members).select(F.col("id").cast("int").alias("member")).mapInArrow(run, schema)
