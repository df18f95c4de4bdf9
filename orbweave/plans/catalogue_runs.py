"""Queries of whole runs and of operators that SQL can't express; tests check them by other means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import evaluation as E
from ..operators import kernels as K
from ..operators import merging as A
from ..operators import phasing as P
from ..operators import slabs as L
from ..sources import mrc, stacks
from ..sources import tables as T
from . import reconstruct as R
from .registry import DET, ORIENT, PX, ROT, VOL, Registry, rounded, rounded_columns
from .settings import Settings

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
SIDE = 9


def two_blobs(n: int = SIDE) -> np.ndarray:
    """Two unequal Gaussians: a density without symmetry."""
    i, j, k = np.meshgrid(*[np.arange(n) - n // 2] * 3, indexing="ij")
    blob = lambda a, b, c, s: np.exp(-((i - a) ** 2 + (j - b) ** 2 + (k - c) ** 2) / (2 * s * s))
    return blob(0, 0, -1, 0.9) + 0.6 * blob(1, 1, 1, 0.7)


@_r.add()
def full_reconstruction(spark, d):
    """Three generations over all driver images; generation, voxel, density."""
    s = Settings(side=7, n_generations=3, n_orientations=100, n_phase_loops=1, n_er=4, n_hio=2, members=2, solve_steps=30, out=T.scratch(spark))
    state = R.run(spark, T.wide(spark, d), T.detector(spark), s)
    got = spark.read.parquet(R.checkpoint_path(s.out, state.generation))
    return got.select("generation", F.posexplode("rho").alias("voxel", "v"))


@_r.add()
def align_search(spark, d):
    """The two blobs turned by a known rotation and brought back."""
    vol = two_blobs()
    q = np.array([np.cos(0.4), 0, np.sin(0.4), 0])
    _, cc, found = E.align(spark, K.rotate(vol, K.matrix_of(q)), vol, coarse=100, best=2, fine=20, rounds=4)
    return spark.createDataFrame([(cc, *map(float, found))], "cc double, w double, x double, y double, z double")


def _solved(spark, d, members: int):
    images = T.wide(spark, d).join(T.orientations(spark, d).select("image_id", F.array(*"wxyz").alias("q")), "image_id").withColumn("member", F.lit(0))
    grids = A.normal_grids(images, R.positions(T.detector(spark), 1.0), SIDE)
    return A.solve(grids, A.lambda_grid(spark, members, images.count() * T.IMAGE**2, SIDE), SIDE)


@_r.add()
def cg_solve_full(spark, d):
    """Normal equations of all images at their orientations, solved for every regulariser."""
    return _solved(spark, d, 3).select("member", "v0", "v1", "v2", "steps", F.size("data").alias("values"))


@_r.add()
def gauss_fit(spark, d):
    return P.fit_histograms(P.histogram(T.voxels(T.wide(spark, d, "vol_id")), 20))


def _zoom_sql(order: int) -> str:
    w = K.interpolation(T.CUBE, np.arange(7) * (T.CUBE - 1) / 6, order)
    values = ", ".join(f"({p}, {i}, {float(w[p, i])!r}::double)" for p in range(7) for i in range(T.CUBE))
    return (
        f"with {VOL}, w(p, i, w) as (values {values}) select vol_id, (a.p * 49 + b.p * 7 + c.p)::int as voxel, round(sum(v * a.w * b.w * c.w), 6) + 0.0 as v "
        "from vol join w a on a.i = vol.i join w b on b.i = vol.j join w c on c.i = vol.k group by all"
    )


def _zoomed(spark, d, order: int):
    got = K.map_volumes(T.wide(spark, d, "vol_id"), lambda v: {"data": np.stack([K.resample(x, 7, order) for x in v])}, {"data": "array<double>"})
    return rounded_columns(got.select("vol_id", F.posexplode("data").alias("voxel", "v")), "v")


@_r.add(_zoom_sql(1))
def zoom_linear(spark, d):
    return _zoomed(spark, d, 1)


@_r.add(_zoom_sql(3))
def zoom_spline(spark, d):
    return _zoomed(spark, d, 3)


def _shift_sql() -> str:
    """A spline's value at a place is the sum of its coefficients, mirrored beyond the ends, times the cubic B-spline at their distances."""
    e = K.spline_matrix(T.CUBE)
    values = ", ".join(f"({k - 2}, {i}, {float(e[k, i])!r}::double)" for k in range(T.CUBE + 4) for i in range(T.CUBE))
    at = "(p + s - k)"
    basis = f"case when abs({at}) < 1 then 2.0 / 3 - {at} * {at} + pow(abs({at}), 3) / 2 when abs({at}) < 2 then pow(2 - abs({at}), 3) / 6 else 0 end"
    weights = ", ".join(
        f"w{c} as (select vol_id, p, i, sum({basis} * e) as w from (select vol_id, s{c} as s from shift) cross join (select unnest(range(0, 4)) as p) cross join e where p + s between 0 and 3 group by all)" for c in "ijk"
    )
    return (
        f"with {VOL}, size as (select vol_id, i, j, k, abs(v) as v from vol), e(k, i, e) as (values {values}), "
        f"shift as (select vol_id, sum(v * i) / sum(v) - 2 as si, sum(v * j) / sum(v) - 2 as sj, sum(v * k) / sum(v) - 2 as sk from size group by 1), {weights}, "
        "found as (select v.vol_id, a.p * 16 + b.p * 4 + c.p as voxel, sum(v.v * a.w * b.w * c.w) as v from size v join wi a on a.vol_id = v.vol_id and a.i = v.i "
        "join wj b on b.vol_id = v.vol_id and b.i = v.j join wk c on c.vol_id = v.vol_id and c.i = v.k group by all) "
        "select s.vol_id, x.voxel::int as voxel, round(coalesce(f.v, 0), 6) + 0.0 as v from shift s cross join (select unnest(range(0, 64)) as voxel) x "
        "left join found f on f.vol_id = s.vol_id and f.voxel = x.voxel"
    )


@_r.add(_shift_sql())
def shift_to_center(spark, d):
    got = K.map_volumes(T.wide(spark, d, "vol_id"), lambda v: {"data": np.stack([K.to_center_of_mass(np.abs(x)) for x in v])}, {"data": "array<double>"})
    return rounded_columns(got.select("vol_id", F.posexplode("data").alias("voxel", "v")), "v")


@_r.add()
def phase_ensemble(spark, d):
    """Every volume of the table taken as a density of which only the autocorrelation is known, phased by two members with different thresholds, all over slabs.
    vol_id, member, skew of the density's histogram, inside (voxels of the support), mass, kept (the member of least skew)."""
    members, thick = 2, T.CUBE // 2
    each = T.wide(spark, d, "vol_id").select(F.explode(F.array(*[F.lit(m) for m in range(members)])).alias("m"), "vol_id", "data")
    start = L.written(L.mapped(L.cut(each.select((F.col("vol_id") * members + F.col("m")).alias("vol_id"), "data"), T.CUBE, thick), np.abs))
    ac = L.roll(L.autocorrelation(start, T.CUBE, thick), T.CUBE, thick, -(T.CUBE // 2))
    weights = each.select((F.col("vol_id") * members + F.col("m")).alias("vol_id"), (0.5 + F.col("m") / members).alias("weight"))
    rho, support = L.retrieve(ac, T.CUBE, thick, start, 1, 1, 1, 0.3, weights=weights)
    skews = P.histogram_skew(P.histogram(L.voxels(rho, T.CUBE, thick, "v")))
    found = L.sums(support).select("vol_id", F.col("s").alias("inside")).join(L.sums(rho).select("vol_id", F.col("s").alias("mass")), "vol_id").join(skews, "vol_id", "left")
    found = found.select(F.expr(f"vol_id div {members}").alias("vol_id"), (F.col("vol_id") % members).cast("int").alias("member"), "skew", "inside", "mass")
    best = found.where("skew is not null and not isnan(skew)").groupBy("vol_id").agg(F.expr("min_by(member, struct(skew, member))").alias("best"))
    return found.join(best, "vol_id", "left").withColumn("kept", F.coalesce(F.col("member") == F.col("best"), F.lit(False))).drop("best")


def _mean_volume(spark, d) -> np.ndarray:
    mean = T.voxels(T.wide(spark, d, "vol_id")).groupBy("i", "j", "k").agg(F.avg("v").alias("v")).orderBy("i", "j", "k").collect()  # 64 rows
    return np.array([r["v"] for r in mean]).reshape((T.CUBE,) * 3)


@_r.add(f"with {VOL} select 2 as generation, (i * 16 + j * 4 + k)::int as voxel, round(avg(v), 6) + 0.0 as rho, round(2 * avg(v), 6) + 0.0 as ac, avg(v) > 0 as support from vol group by i, j, k")
def checkpoint_roundtrip(spark, d):
    """The mean volume, saved as a generation's result and loaded."""
    out, vol = T.scratch(spark), _mean_volume(spark, d)
    R.save(spark, out, R.State(2, 2 * vol, vol > 0, vol, 0.5))
    back = R.load(spark, out, R.saved_generations(spark, out)[-1])
    rows = [(back.generation, p, float(r), float(a), bool(s)) for p, (r, a, s) in enumerate(zip(back.rho.ravel(), back.ac.ravel(), back.support.ravel(), strict=True))]
    return rounded_columns(spark.createDataFrame(rows, "generation int, voxel int, rho double, ac double, support boolean"), "rho", "ac")


@_r.add(f"with {VOL} select [4, 4, 4]::int[] as side, 2.5::double as voxel, (i * 16 + j * 4 + k)::int as p, round(avg(v), 5) + 0.0 as v from vol group by i, j, k")
def mrc_roundtrip(spark, d):
    """The mean volume, written as an MRC file and read."""
    out = T.scratch(spark)
    mean = T.voxels(T.wide(spark, d, "vol_id")).groupBy("i", "j", "k").agg(F.avg("v").alias("v"))
    planes = mean.groupBy(F.col("i").alias("image_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "k", "v"))), lambda x: x["v"]).alias("data"))  # a plane has a fixed size
    stacks.write_stack(planes, f"{out.removeprefix('file://')}/mean.mrc", T.CUBE, T.CUBE, T.CUBE, 2.5)
    return rounded_columns(mrc.read_volumes(spark, f"{out}/mean.mrc").select("side", "voxel", F.posexplode("data").alias("p", "v")), "v", digits=5)


@_r.add()
def uniform_orientations(spark, d):
    q = R.random_orientations(T.wide(spark, d).select("image_id"), 5)
    return q.select("image_id", *[rounded(F.col("q")[i]).alias(n) for i, n in enumerate("wxyz")])


@_r.add()
def preferred_orientations(spark, d):
    """Rotations scattered around each image's own by normal angles of 0.1."""
    q = T.orientations(spark, d)
    draw = q.select("*", *[F.randn(11 + i).alias(f"n{i}") for i in range(4)])
    near = Q.near(Q.quat(), tuple(F.col(f"n{i}") for i in range(3)), 0.1 * F.col("n3"))
    return rounded_columns(draw.select("image_id", *[x.alias(n) for n, x in zip("wxyz", near, strict=True)]), "w", "x", "y", "z")


#: Images of a file of the stream, at least, once a part is more than one file.
_FILE_ROWS = 50_000


@_r.add(
    "with n as (select count(*) as n from embeddings), r as (select row_number() over (order by vec_id) - 1 as rank, unnest(embedding)::double as v from embeddings), "
    "s as (select floor(rank * 5 / n) as share, count(*) as c, sum(v) as t from r cross join n group by 1), "
    "seen as (select sum(c) over (order by share) as c, sum(t) over (order by share) as t from s), g as (select unnest(range(0, n // 100))::int as generation from n) "
    "select generation, min(c)::bigint as n, round(arg_min(t, c) / min(c), 6) + 0.0 as mean from g join seen on c >= (generation + 1) * 6400 group by 1"
)
def stream_reconstruction(spark, d):
    """Driver images as a stream of five parts in order, each one file while it is small; a mean image for each 100 images, over all that are in by then."""
    from ..streaming.generations import run_stream

    out = T.scratch(spark)
    images = T.ranked(T.wide(spark, d), "image_id")
    n = images.count()
    files = max(1, n // 5 // _FILE_ROWS)
    for i in range(5):  # one after the other, as the stream reads files in order of their times
        own = images.where(F.floor(F.col("rank") * 5 / n) == i).drop("rank")
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.parquet(f"{out}/source/file={i}")
    spans = []  # a row for each part

    def means(numbers, images):
        got = images.select(F.explode("data").alias("v")).agg(F.count("*"), F.avg("v")).first()
        spans.append((numbers.start, numbers.stop - 1, got[0], got[1]))

    source = spark.readStream.schema("image_id long, data array<double>").option("maxFilesPerTrigger", files).parquet(f"{out}/source").select("image_id", "data")
    run_stream(spark, source, f"{out}/store", f"{out}/checkpoint", 100, means, together=True)
    rows = spark.createDataFrame(spans, "first int, last int, n long, mean double")
    return rounded_columns(rows.select(F.explode(F.sequence("first", "last")).alias("generation"), "n", "mean"), "mean")


@_r.add("with each_ as (select unnest(embedding)::double as v, unnest(range(0, 64))::int as p from embeddings) select p, count(*) as n, round(avg(v), 6) + 0.0 as v from each_ group by p")
def stream_running_mean(spark, d):
    """The mean image of a stream of five files, kept by a stateful operator from what is new in each micro-batch."""
    from ..streaming import running

    out = T.scratch(spark)
    T.wide(spark, d).repartition(5).write.parquet(f"{out}/source")
    source = spark.readStream.schema("image_id long, data array<double>").option("maxFilesPerTrigger", 1).parquet(f"{out}/source")
    running.run_sums(spark, source, f"{out}/sums", f"{out}/mark")
    return rounded_columns(running.mean_image(running.latest(spark, f"{out}/sums")), "v")


_GRID = 40


def _match_sql(grid: int = _GRID) -> str:
    quats = ", ".join(f"({i}, {', '.join(repr(float(x)) + '::double' for x in q)})" for i, q in enumerate(E.uniform_rotations(grid)))
    rot = ROT.replace("image_id", "ref_id").replace("from orient", "from quat")
    return (
        f"with {PX}, {DET}, quat(ref_id, w, x, y, z) as (values {quats}), {rot}, far as (select max(sqrt(qx * qx + qy * qy + qz * qz)) as far from det), "
        "place as (select ref_id, r, c, (m00 * qx + m10 * qy + m20 * qz) * pi() / far as h, (m01 * qx + m11 * qy + m21 * qz) * pi() / far as k, (m02 * qx + m12 * qy + m22 * qz) * pi() / far as l from rot cross join det cross join far), "
        "vox as (select p // 16 - 2 as x, (p // 4) % 4 - 2 as y, p % 4 - 2 as z, avg(v) as v from each_ group by p), "
        "slices as (select ref_id, r, c, sum(v * cos(h * x + k * y + l * z)) as s from place cross join vox group by 1, 2, 3), "
        "f as (select (select stddev_pop(v) from each_) / (select stddev_pop(s) from slices) as f), "
        "dist as (select image_id, ref_id, sum((v - f * s) * (v - f * s)) as d from px join slices using (r, c) cross join f group by 1, 2), "
        "best as (select image_id, arg_min(ref_id, d) as ref_id, min(d) as d from dist group by 1) "
        "select image_id, round(w, 6) + 0.0 as w, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z, round(d, 5) + 0.0 as distance from best join quat using (ref_id)"
    )


@_r.add(_match_sql())
def model_match(spark, d):
    """Every image with the nearest slice of the mean volume over a grid of rotations, slices scaled to the images."""
    from ..operators import matching as M

    got = M.match_model(T.wide(spark, d), _mean_volume(spark, d), E.uniform_rotations(_GRID), R.positions(T.detector(spark), 1.0))
    return rounded_columns(got.select("image_id", *[rounded(F.col("q")[i]).alias(n) for i, n in enumerate("wxyz")], "distance"), "distance", digits=5)


_NESTED = 300


@_r.add(_match_sql(_NESTED))
def nested_match(spark, d):
    """As model_match, over more rotations and from coarse to fine: cells of rotations are left out by the triangle inequality."""
    from ..operators import rotation_grid as G

    got = G.match_nested(T.wide(spark, d), _mean_volume(spark, d), E.uniform_rotations(_NESTED), R.positions(T.detector(spark), 1.0))
    return rounded_columns(got.select("image_id", *[rounded(F.col("q")[i]).alias(n) for i, n in enumerate("wxyz")], "distance"), "distance", digits=5)


def _part(u: str) -> str:
    return f"greatest(0, least(3, floor(4 * ({u}))))::bigint"


@_r.add(
    f"with {ORIENT}, turned as (select image_id, w * w + z * z - x * x - y * y as height, (atan2(z, w) + atan2(y, x)) / (2 * pi()) as s, (atan2(z, w) - atan2(y, x)) / (2 * pi()) as t from orient), "
    f"part as (select image_id, {_part('(height + 1) / 2')} as h, {_part('s - floor(s)')} as s, {_part('t - floor(t)')} as t from turned), "
    "cell as (select image_id, h // 2 * 32 + s // 2 * 16 + t // 2 * 8 + h % 2 * 4 + s % 2 * 2 + t % 2 as cell from part) "
    "select cell, cell // 8 as parent, count(*) as n, min(image_id) as first from cell group by 1"
)
def rotation_cells(spark, d):
    """The second level of the nested grid of rotations: each cell that holds orientations of the table, its parent, and how many they are."""
    from ..operators import rotation_grid as G

    own = T.orientations(spark, d).select("image_id", G.cell_of(Q.quat(), 2).alias("cell"))
    return own.groupBy("cell").agg(F.count("*").alias("n"), F.min("image_id").alias("first")).withColumn("parent", F.expr("cell div 8"))
