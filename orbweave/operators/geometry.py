"""Positions of oriented pixels in reciprocal space."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quaternion import inverse_rotate, quat
from .detector import distance


def rotate_positions(orient: DataFrame, det: DataFrame) -> DataFrame:
    """image_id, panel, r, c, h, k, l: every pixel of every orientation. The detector is one table of fixed size."""
    at = orient.join(F.broadcast(det), how="cross")
    h, k, l = inverse_rotate(quat(), (F.col("qx"), F.col("qy"), F.col("qz")))
    return at.select("image_id", "panel", "r", "c", h.alias("h"), k.alias("k"), l.alias("l"))


def normalise(positions: DataFrame, det: DataFrame, oversampling: float = 1.0) -> DataFrame:
    """Positions in radians: the detector's edge comes to pi / oversampling."""
    far = det.agg(F.max(distance()).alias("far"))
    scaled = positions.crossJoin(F.broadcast(far))
    return scaled.select("image_id", "panel", "r", "c", *[(F.col(n) * math.pi / (F.col("far") * oversampling)).alias(n) for n in "hkl"])


def positions_from_energy(pixels: DataFrame, energy_ev: float | Column) -> DataFrame:
    """Reciprocal positions qx, qy, qz (inverse metres) from places x, y, z (metres) behind the sample and the photon energy."""
    wavelength = 1.23984198e-6 / energy_ev
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    q = {n: (F.col(n) / norm - (1.0 if n == "z" else 0.0)) / wavelength for n in "xyz"}
    return pixels.withColumns({f"q{n}": c for n, c in q.items()}).drop("x", "y", "z")


def check_domain(positions: DataFrame, most: float = 3 * math.pi) -> DataFrame:
    """One row: the largest coordinate, and whether it is within what the transforms take."""
    top = F.max(F.greatest(*[F.abs(F.col(n)) for n in "hkl"]))
    return positions.agg(top.alias("largest"), (top < most).alias("inside"))


def reciprocal_mesh(spark, n: int, most: float) -> DataFrame:
    """i, j, k, x, y, z of an n-cube mesh between -most and most."""
    step = 2 * most / (n - 1)
    at = spark.range(n**3).select(F.floor(F.col("id") / (n * n)).cast("int").alias("i"), (F.floor(F.col("id") / n) % n).cast("int").alias("j"), (F.col("id") % n).cast("int").alias("k"))
    return at.select("*", *[(F.col(a) * step - most).alias(b) for a, b in zip("ijk", "xyz", strict=True)])


def antisupport(spark, n: int, oversampling: float = 1.0) -> DataFrame:
    """i, j, k, outside: frequencies beyond the sampled ball; rounded so that float noise can't break the symmetry."""
    mesh = reciprocal_mesh(spark, n, math.pi)
    return mesh.select("i", "j", "k", (F.round(distance("x", "y", "z"), 4) > round(math.pi / oversampling, 4)).alias("outside"))
