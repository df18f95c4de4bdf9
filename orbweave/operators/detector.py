"""Operators over pixels: reduction, clipping, binning, profiles. All are native; a group is a pixel, bin or image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAXS_BINS = 100


def distance(x: str = "qx", y: str = "qy", z: str = "qz") -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))


def mean_image(px: DataFrame) -> DataFrame:
    return px.groupBy("panel", "r", "c").agg(F.avg("v").alias("v"))


def bin_pixels(px: DataFrame, n: int, how: str, value: str = "v", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Blocks of 2^n x 2^n pixels by sum, mean, or index (least place, divided down). Sizes must be multiples of 2^n."""
    f = 2**n
    by = [*keys, "panel", F.floor(F.col("r") / f).cast("int").alias("r"), F.floor(F.col("c") / f).cast("int").alias("c")]
    what = {"sum": F.sum(value), "mean": F.sum(value) / (f * f), "index": F.floor(F.min(value) / f)}[how]
    return px.groupBy(*by).agg(what.alias(value))


def clip(px: DataFrame, n: int, rows: int, cols: int, panels: int) -> DataFrame:
    """The low-resolution part, 2^n times smaller each way: the inner corner of each of four panels, or a single panel's centre."""
    f = 2**n
    h, w = rows // f, cols // f
    if panels == 4:
        # panels 0 and 2 end at the beam with their last columns, 1 and 3 with their first
        right = F.when(F.col("panel") % 2 == 0, cols - w).otherwise(0)
        r0, c0 = F.lit(rows - h), right
    elif panels == 1:
        r0, c0 = F.lit(rows // 2 - rows // (2 * f)), F.lit(cols // 2 - cols // (2 * f))
        h, w = 2 * (rows // (2 * f)), 2 * (cols // (2 * f))
    else:
        raise ValueError(f"clipping takes 1 or 4 panels, not {panels}")
    kept = px.where((F.col("r") >= r0) & (F.col("r") < r0 + h) & (F.col("c") >= c0) & (F.col("c") < c0 + w))
    return kept.withColumn("r", (F.col("r") - r0).cast("int")).withColumn("c", (F.col("c") - c0).cast("int"))


def clip_index(px: DataFrame, n: int, rows: int, cols: int, panels: int, value: str) -> DataFrame:
    """Clipped places, counted from their least one."""
    kept = clip(px, n, rows, cols, panels)
    return kept.crossJoin(F.broadcast(kept.agg(F.min(value).alias("__least")))).withColumn(value, F.col(value) - F.col("__least")).drop("__least")


def saxs(px: DataFrame, det: DataFrame, keys: tuple[str, ...] = (), bins: int = SAXS_BINS) -> DataFrame:
    """bin, q, v: the mean value by distance, for each of ``keys``. The bin after the last holds the largest distance alone."""
    far = det.agg(F.max(distance()).alias("far"))
    q = det.crossJoin(F.broadcast(far)).select("panel", "r", "c", "far", F.floor(bins * distance() / F.col("far")).cast("int").alias("bin"))
    got = px.join(F.broadcast(q), ["panel", "r", "c"]).groupBy(*keys, "bin", "far").agg(F.avg("v").alias("v"))
    return got.select(*keys, "bin", (F.col("bin") * F.col("far") / bins).alias("q"), "v")


def fluctuation_factor(px: DataFrame, det: DataFrame, bins: int = SAXS_BINS, least: float = 0.1) -> DataFrame:
    """image_id, factor: how much weaker an image is than the mean, over the bright bins of the first quarter of its profile."""
    quarter = (bins + 1) // 4
    mean = saxs(mean_image(px), det, bins=bins).select("bin", F.col("v").alias("m"))
    own = saxs(px, det, ("image_id",), bins).where((F.col("bin") < quarter) & (F.col("v") > least))
    return own.join(F.broadcast(mean), "bin").groupBy("image_id").agg(F.avg(F.col("m") / F.col("v")).alias("factor"))


def rescale(px: DataFrame, factors: DataFrame) -> DataFrame:
    """Pixels times their image's factor (1 where it has none)."""
    return px.join(factors, "image_id", "left").withColumn("v", F.col("v") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def resolution_weights(det: DataFrame, order: int) -> DataFrame:
    """Weights by inverse distance (in inverse Angstrom) to a power, with sum 1; the origin, if a pixel lies there, weighs 0."""
    raw = det.withColumn("w", F.coalesce(F.try_divide(F.lit(1.0), F.pow(F.abs(distance() * 1e-10), F.lit(float(order)))), F.lit(0.0)))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("w").alias("all")))).withColumn("w", F.col("w") / F.col("all")).drop("all")


def assemble(px: DataFrame, det: DataFrame) -> DataFrame:
    """image_id, ix, iy, v: pixels at their places in the assembled image, zeros as null."""
    return px.join(F.broadcast(det.select("panel", "r", "c", "ix", "iy")), ["panel", "r", "c"]).select("image_id", "ix", "iy", F.nullif(F.col("v"), F.lit(0.0)).alias("v"))


def blocks(images: DataFrame, size: int) -> DataFrame:
    """Images with the worker whose contiguous block holds them."""
    return images.withColumn("worker", F.floor(F.col("image_id") / size))
