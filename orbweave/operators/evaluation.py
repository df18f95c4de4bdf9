"""How good a density is: correlation, Fourier shells, resolution, alignment and convergence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels


def pearson(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """by, cc: the correlation of the values ``v`` of two long tables over ``keys``, for each ``by`` of the first."""
    both = a.join(b.select(*keys, F.col("v").alias("v2")), keys)
    return both.groupBy(by).agg(F.corr("v", "v2").alias("cc"))


def fourier(volumes: DataFrame) -> DataFrame:
    """vol_id, re, im (arrays): the transform of each cube, shifted so that the origin lies in the middle."""

    def fn(v: np.ndarray) -> dict[str, np.ndarray]:
        f = np.fft.fftshift(np.fft.fftn(v, axes=(-3, -2, -1)), axes=(-3, -2, -1))
        return {"re": f.real, "im": f.imag}

    return kernels.map_volumes(volumes, fn, {"re": "array<double>", "im": "array<double>"})


def shell_correlation(pairs: DataFrame, n: int, most: float, spacing: float) -> DataFrame:
    """pair, shell, r, fsc. pairs: pair, a and b (arrays re, im of two transforms).

    Shells are open at both ends: the origin and frequencies on a boundary belong to none. Frequencies run from -most to most.
    """
    flat = pairs.select("pair", F.posexplode(F.arrays_zip("re1", "im1", "re2", "im2")).alias("p", "x"))
    step = 2 * most / (n - 1)
    side = [F.floor(F.col("p") / (n * n)), F.floor(F.col("p") / n) % n, F.col("p") % n]
    s = F.sqrt(sum(((x * step - most) * (x * step - most) for x in side), F.lit(0.0)))
    top = most  # the corner lies at most * sqrt(3)
    flat = flat.select("pair", "x", s.alias("s")).withColumn("shell", F.floor(F.col("s") / spacing).cast("int"))
    inside = flat.where((F.col("s") > F.col("shell") * spacing) & (F.col("s") < (F.col("shell") + 1) * spacing) & (F.col("shell") * spacing < top))
    x = {c: F.col(f"x.{c}") for c in ("re1", "im1", "re2", "im2")}
    got = inside.groupBy("pair", "shell").agg(
        F.sum(x["re1"] * x["re2"] + x["im1"] * x["im2"]).alias("num"),
        F.sum(x["re1"] * x["re1"] + x["im1"] * x["im1"]).alias("p1"),
        F.sum(x["re2"] * x["re2"] + x["im2"] * x["im2"]).alias("p2"),
    )
    return got.select("pair", "shell", ((F.col("shell") + 0.5) * spacing).alias("r"), F.try_divide(F.col("num"), F.sqrt(F.col("p1") * F.col("p2"))).alias("fsc"))


def resolution(curve: DataFrame, level: float = 0.5) -> DataFrame:
    """pair, resolution: one over the radius at which the curve, sorted by correlation, passes the level; -1 if it doesn't."""
    w = Window.partitionBy("pair").orderBy("fsc", "r")
    at = curve.where("fsc is not null").select("pair", "fsc", "r", F.lead("fsc").over(w).alias("fsc2"), F.lead("r").over(w).alias("r2"))
    hit = (F.col("fsc") <= level) & (F.col("fsc2") > level)
    r = F.col("r") + (level - F.col("fsc")) / (F.col("fsc2") - F.col("fsc")) * (F.col("r2") - F.col("r"))
    got = at.groupBy("pair").agg(F.min(F.when(hit, r)).alias("r"))
    return got.select("pair", F.coalesce(F.try_divide(F.lit(1.0), F.col("r")), F.lit(-1.0)).alias("resolution"))


def convergence(history: DataFrame, least: float, change: float, absolute: bool = False) -> DataFrame:
    """history (generation, cc) with delta_cc and converged. The change is signed unless ``absolute``: a drop converges too."""
    delta = F.col("cc") - F.lag("cc", 1, 0.0).over(Window.orderBy("generation"))  # one row for each generation
    size = F.abs(F.col("delta_cc")) if absolute else F.col("delta_cc")
    return history.withColumn("delta_cc", delta).withColumn("converged", (F.col("cc") > least) & (size < change))


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    size = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / size) if size else 0.0


def score_rotations(spark: SparkSession, moving: np.ndarray, fixed: np.ndarray, quats: np.ndarray) -> DataFrame:
    """id, w, x, y, z, cc of each candidate rotation; candidates are spread over tasks, the two volumes have a fixed size."""

    def run(batches):
        for b in batches:
            q = np.stack([b.column(i).to_numpy() for i in range(1, 5)], axis=1)
            cc = [correlation(kernels.rotate(moving, kernels.matrix_of(x)), fixed) for x in q]
            yield pa.record_batch([*b.columns, pa.array(cc, pa.float64())], names=["id", "w", "x", "y", "z", "cc"])

    rows = [(i, *map(float, q)) for i, q in enumerate(quats)]
    table = spark.createDataFrame(rows, "id long, w double, x double, y double, z double").repartition(spark.sparkContext.defaultParallelism)
    return table.mapInArrow(run, "id long, w double, x double, y double, z double, cc double")


def _around(base: np.ndarray, sigma: float, n: int, rng: np.random.Generator) -> np.ndarray:
    axis = rng.normal(size=(n, 3))
    axis /= np.linalg.norm(axis, axis=1, keepdims=True)
    half = rng.normal(scale=sigma, size=n) / 2
    p = np.concatenate((np.cos(half)[:, None], np.sin(half)[:, None] * axis), axis=1)
    b, c, d = base[1:]
    a = base[0]
    e, f, g, h = p.T
    q = np.stack([e * a - f * b - g * c - h * d, e * b + f * a + g * d - h * c, e * c - f * d + g * a + h * b, e * d + f * c - g * b + h * a], axis=1)
    return np.concatenate((base[None], q))


def uniform_rotations(n: int) -> np.ndarray:
    """A deterministic, even covering of rotations: three additive low-discrepancy sequences through Shoemake's map."""
    i = np.arange(n)
    root = 1.2207440846057596  # the real root of x^4 = x + 1
    u = np.stack([(0.5 + i * root**-j) % 1 for j in (1, 2, 3)])
    lo, hi = np.sqrt(1 - u[0]), np.sqrt(u[0])
    t = 2 * np.pi
    return np.stack([hi * np.cos(t * u[2]), lo * np.sin(t * u[1]), lo * np.cos(t * u[1]), hi * np.sin(t * u[2])], axis=1)


def align(spark: SparkSession, moving: np.ndarray, fixed: np.ndarray, coarse: int = 200, best: int = 2, fine: int = 30, rounds: int = 8, blur: float = 0.0, seed: int = 0) -> tuple[np.ndarray, float, np.ndarray]:
    """(moving brought onto fixed, correlation, quaternion): both hands, coarse search, then finer and finer around the best.

    A fine search ends when a round is worse than the one before.
    """
    rng = np.random.default_rng(seed)
    moving, fixed = kernels.to_center_of_mass(moving), kernels.to_center_of_mass(fixed)
    if moving.shape != fixed.shape:
        moving = kernels.resample(moving, fixed.shape[0])
    if blur:
        moving, fixed = (kernels.gauss(v, blur, "reflect") for v in (moving, fixed))
    top: tuple[float, np.ndarray, np.ndarray] | None = None
    for hand in (moving, moving[::-1, ::-1, ::-1]):
        starts = score_rotations(spark, hand, fixed, uniform_rotations(coarse)).orderBy(F.desc("cc"), "id").limit(best).collect()
        for s in starts:
            q, cc = np.array([s[c] for c in "wxyz"]), s["cc"]
            for n in range(rounds):
                found = score_rotations(spark, hand, fixed, _around(q, max(0.2, 2 - 0.2 * n) / 4, fine, rng)).orderBy(F.desc("cc"), "id").first()
                if found["cc"] < cc:
                    break
                q, cc = np.array([found[c] for c in "wxyz"]), found["cc"]
            if top is None or cc > top[0]:
                top = (cc, q, hand)
    return kernels.rotate(top[2], kernels.matrix_of(top[1])), top[0], top[1]
