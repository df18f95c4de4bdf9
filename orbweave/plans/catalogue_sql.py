"""Queries written in Spark SQL over the registered functions, and over the data source of stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..sources import stacks
from ..sources import tables as T
from . import catalogue_volumes
from .registry import Registry, rounded

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _views(spark, d):
    sql.register(spark)
    T.wide(spark, d, "vol_id").createOrReplaceTempView("orbweave_volumes")


@_r.add(catalogue_volumes.ORACLE_SQL["nufft_type2_direct"])
def sql_volume_at(spark, d):
    """Slicing in SQL: every volume's transform at eight points."""
    _views(spark, d)
    return spark.sql("""
        with points as (select transform(a, x -> 0.1d * x) as h, transform(a, x -> 0.2d * x) as k, transform(a, x -> -0.15d * x) as l from (select sequence(1, 8) as a)),
        at as (select vol_id, posexplode(volume_at(data, h, k, l)) as (p, x) from orbweave_volumes cross join points)
        select vol_id, p + 1 as point, round(x.re, 6) + 0.0d as re, round(x.im, 6) + 0.0d as im from at""")


@_r.add(catalogue_volumes.ORACLE_SQL["nufft_type1_direct"])
def sql_grid_points(spark, d):
    """Gridding in SQL: every image's values brought to a cube of side three."""
    _views(spark, d)
    return spark.sql("""
        with pixels as (select vol_id, data, transform(sequence(0, 63), p -> 0.1d * (p div 8)) as h, transform(sequence(0, 63), p -> 0.2d * (p % 8)) as k,
          transform(sequence(0, 63), p -> 0.05d * ((p div 8) + p % 8)) as l from orbweave_volumes),
        grid as (select vol_id, posexplode(grid_points(data, h, k, l, 3)) as (p, x) from pixels)
        select vol_id as image_id, cast(p div 9 as int) as i, cast(p div 3 % 3 as int) as j, cast(p % 3 as int) as k, round(x.re, 6) + 0.0d as re, round(x.im, 6) + 0.0d as im from grid""")


@_r.add(catalogue_volumes.ORACLE_SQL["fsc_curve"])
def sql_fourier_shells(spark, d):
    """Shell correlation in SQL: every even volume with the one after it."""
    _views(spark, d)
    return spark.sql("""
        select a.vol_id div 2 as pair, s.shell, round(s.r, 6) + 0.0d as r, round(s.fsc, 5) + 0.0d as fsc
        from orbweave_volumes a join orbweave_volumes b on b.vol_id = a.vol_id + 1 and a.vol_id % 2 = 0,
        lateral fourier_shells(a.data, b.data, 1.0d, 0.3d) s""")


def _saved(spark, d, parts: int):
    """All images of the table as stacks in a new folder, in order of their ids."""
    out = T.scratch(spark)
    images = T.ranked(T.wide(spark, d), "image_id")
    n = images.count()
    for p in range(parts):
        a, b = n * p // parts, n * (p + 1) // parts
        own = images.where((F.col("rank") >= a) & (F.col("rank") < b)).select((F.col("rank") - a).alias("image_id"), "data")
        stacks.write_stack(own, f"{_path(out)}/run_{p:03d}.mrc", b - a, T.IMAGE, T.IMAGE)
    return _path(out), n


def _path(folder: str) -> str:
    return folder.removeprefix("file://") if folder.startswith("file://") else folder


_IMAGES = "im as (select embedding, row_number() over (order by vec_id) - 1 as image_id, count(*) over () as n from embeddings)"


@_r.add(f"with {_IMAGES}, px as (select image_id, unnest(range(0, 64))::int as p, unnest(embedding)::double as v from im where image_id >= n // 4 and image_id < 3 * n // 4) select * from px")
def stack_range_scan(spark, d):
    """The middle half of all images, read from two stacks that hold them; only their bytes are read."""
    path, n = _saved(spark, d, 2)
    part = stacks.read_stacks(spark, path).where((F.col("image_id") >= n // 4) & (F.col("image_id") < 3 * n // 4))
    return part.select("image_id", F.posexplode("data").alias("p", "v")).withColumn("v", F.col("v").cast("double"))


@_r.add(f"with {_IMAGES} select image_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) + 0.0 as total from im")
def stack_stream(spark, d):
    """All images as a stream of stacks: total of each. The stream is drained, and what it has written is the result."""
    path, _ = _saved(spark, d, 3)
    out = T.scratch(spark)
    stream = spark.readStream.format(stacks.NAME).option("bytes", 1 << 16).load(path)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/mark").trigger(availableNow=True).start(f"{out}/images")
    query.awaitTermination()
    total = F.aggregate(F.col("data").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return spark.read.schema(stacks.SCHEMA).parquet(f"{out}/images").select("image_id", rounded(total).alias("total"))
