"""Images, detectors, volumes and orientations as DataFrames.

Long form: pixels (image_id, panel, r, c, v), voxels (vol_id, i, j, k, v). Wide form: one row for each image or volume with its
values in ``data``. The driver tables stand in for measured data: an embedding of 64 values is a 1 x 8 x 8 image, a four-panel
image of 4 x 4 pixels, or a 4 x 4 x 4 volume.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = 8
CUBE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir. On one machine, where it may be unset, in /tmp/checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/orbweave-{uuid.uuid4().hex}"


def wide(spark: SparkSession, sf_dir: str, id_name: str = "image_id") -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(id_name), F.col("embedding").cast("array<double>").alias("data"))


def pixels(images: DataFrame, rows: int = IMAGE, cols: int = IMAGE) -> DataFrame:
    """Wide images as long pixels; panels of rows x cols pixels follow one another."""
    p = images.select("image_id", F.posexplode("data").alias("p", "v"))
    return p.select("image_id", *[e.cast("int").alias(n) for n, e in _place(F.col("p"), rows, cols).items()], "v")


def _place(p: Column, rows: int, cols: int) -> dict[str, Column]:
    return {"panel": F.floor(p / (rows * cols)), "r": F.floor(p % (rows * cols) / cols), "c": p % cols}


def voxels(volumes: DataFrame, size: int = CUBE) -> DataFrame:
    """Wide cubes as long voxels."""
    p = volumes.select("vol_id", F.posexplode("data").alias("p", "v"))
    at = {"i": F.floor(F.col("p") / (size * size)), "j": F.floor(F.col("p") / size) % size, "k": F.col("p") % size}
    return p.select("vol_id", *[e.cast("int").alias(n) for n, e in at.items()], "v")


def detector(spark: SparkSession, rows: int = IMAGE, cols: int = IMAGE) -> DataFrame:
    """A flat detector around the beam: panel, r, c, qx, qy, qz and the place (ix, iy) of each pixel in the assembled image."""
    half = lambda n: (n - 1) / 2
    px = spark.range(rows * cols).select(F.lit(0).alias("panel"), F.floor(F.col("id") / cols).cast("int").alias("r"), (F.col("id") % cols).cast("int").alias("c"))
    return px.select(
        "*", (F.col("c") - half(cols)).alias("qx"), (F.col("r") - half(rows)).alias("qy"), F.lit(0.0).alias("qz"),
        (F.lit(rows - 1) - F.col("r")).alias("ix"), F.col("c").alias("iy"),
    )


def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and a unit quaternion (w, x, y, z) from the first four values of each vector."""
    q = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("wxyz")])
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in "wxyz"), F.lit(0.0)))
    return q.select("image_id", *[(F.col(n) / norm).alias(n) for n in "wxyz"])


def range_scan(images: DataFrame, start: int, end: int, id_name: str = "image_id") -> DataFrame:
    """The images start to end - 1. Fails if there are fewer; the predicate reaches the file scan."""
    found = images.where((F.col(id_name) >= start) & (F.col(id_name) < end))
    n = found.select(id_name).count()
    if n < end - start:
        raise ValueError(f"{end - start} images are asked for, there are {n}")
    return found


def ranked(df: DataFrame, order: str, name: str = "rank", totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the position (from 0) of each row by ``order``; equal values go by a hash of the whole row. Nothing is brought to one task.

    totals: names of running sums, each with the column that it sums up to and with the row. A range exchange sorts the rows over all partitions; they are
    written as they lie and numbered within their partitions, whose counts and sums (a row for each partition) come to the driver.
    Values of ``order`` may be sparse, negative or repeated, up to all of them.
    """
    from pyspark.sql import Window

    spark, totals = df.sparkSession, totals or {}
    keys = [order, "__tie", "__spread"]
    rows = df.withColumns({"__tie": F.xxhash64(*df.columns), "__spread": F.monotonically_increasing_id() % 64})
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    path = scratch(spark)
    rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33).cast("int")).drop("__tie", "__spread").write.parquet(path)
    rows = spark.read.parquet(path)
    parts = rows.groupBy("__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"), *[F.sum(c).alias(n) for n, c in totals.items()]).orderBy("__part").collect()
    before, starts = [0] * (1 + len(totals)), []
    for p in parts:
        starts.append((p["__part"], before[0] - p["__first"], *before[1:]))
        before = [before[0] + p["__n"], *(b + (p[n] or 0) for b, n in zip(before[1:], totals, strict=True))]
    kinds = dict(rows.select(*[F.sum(c).alias(n) for n, c in totals.items()]).dtypes) if totals else {}
    schema = ", ".join(["__part int", "__shift long", *(f"__{n} {kinds[n]}" for n in totals)])
    starts = spark.createDataFrame([(*s[:2], *(float(x) if kinds[n] == "double" else x for n, x in zip(totals, s[2:], strict=True))) for s in starts], schema)
    rows = rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__row") + F.col("__shift"))
    within = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__{n}") for n, c in totals.items()})
    return rows.drop("__part", "__row", "__shift", *[f"__{n}" for n in totals])
