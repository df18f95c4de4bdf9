"""Queries over pixels, orientations, matches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import detector as D
from ..operators import geometry as G
from ..operators import matching as M
from ..operators import nearest as N
from ..operators import reports
from ..sources import tables as T
from ..streaming import generations as S
from .registry import DET, HKL, ORIENT, PAIRS, PX, PX4, ROT, VOL, Registry, rounded, rounded_columns, sql_columns

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _px(spark, d):
    return T.pixels(T.wide(spark, d))


def _px4(spark, d):
    return T.pixels(T.wide(spark, d), 4, 4)


def _bright(spark, d):
    return _px(spark, d).withColumn("v", 64 * F.col("v") * F.col("v"))


def _asked(spark, d):
    """The stated query set of the searches: every image whose id is divisible by 20. All other images are its references."""
    return T.wide(spark, d).where("image_id % 20 = 0")


def _refs(spark, d):
    return T.wide(spark, d, "ref_id")


@_r.add(f"with {PX} select image_id, count(*) as n, round(sum(v), 6) + 0.0 as total from px where image_id >= 100 and image_id < 150 group by 1")
def slice_range_scan(spark, d):
    found = T.pixels(T.range_scan(T.wide(spark, d), 100, 150))
    return found.groupBy("image_id").agg(F.count("*").alias("n"), rounded(F.sum("v")).alias("total"))


@_r.add(f"with {PX} select image_id // 50 as worker, count(distinct image_id) as images, round(sum(v), 6) + 0.0 as total from px group by 1")
def worker_block_scan(spark, d):
    px = T.pixels(D.blocks(T.wide(spark, d), 50).select("image_id", "data"))
    return D.blocks(px, 50).groupBy("worker").agg((F.count("*") / 64).cast("long").alias("images"), rounded(F.sum("v")).alias("total"))


@_r.add("select (row_number() over (order by event_id) - 1) % 4 + 1 as worker, event_id from events")
def round_robin_route(spark, d):
    return S.route(T.table(spark, d, "events"), 4).select("worker", "event_id")


@_r.add("select vec_id as image_id, ntile(7) over (order by vec_id) - 1 as share from embeddings")
def contiguous_split(spark, d):
    images = T.ranked(T.wide(spark, d).select("image_id"), "image_id")
    n = images.count()
    q, big = divmod(n, 7)
    share = F.when(F.col("rank") < big * (q + 1), F.floor(F.col("rank") / (q + 1))).otherwise(big + F.floor((F.col("rank") - big * (q + 1)) / max(1, q)))
    return images.select("image_id", share.alias("share"))


@_r.add(f"with {PX} select panel, r, c, round(avg(v), 6) + 0.0 as v from px group by all")
def mean_image(spark, d):
    return rounded_columns(D.mean_image(_px(spark, d)), "v")


@_r.add(f"with {DET}, {ORIENT}, {ROT}, {HKL} select image_id, panel, r, c, round(sqrt(h * h + k * k + l * l), 6) + 0.0 as q from hkl")
def pixel_distance(spark, d):
    """Of every image's rotated pixels."""
    at = G.rotate_positions(T.orientations(spark, d), T.detector(spark))
    return at.select("image_id", "panel", "r", "c", rounded(D.distance(*"hkl")).alias("q"))


_BINNED = "q as (select panel, r, c, floor(100 * sqrt(qx * qx + qy * qy + qz * qz) / (select max(sqrt(qx * qx + qy * qy + qz * qz)) from det))::int as bin from det)"


@_r.add(
    f"with {PX}, {DET}, {_BINNED}, far as (select max(sqrt(qx * qx + qy * qy + qz * qz)) as f from det), "
    "per as (select bin, avg(v) as v from px join q using (panel, r, c) group by 1) "
    "select b as bin, round(b * f / 100, 6) + 0.0 as q, round(v, 6) + 0.0 as v from (select unnest(range(0, 101))::int as b) cross join far left join per on b = bin"
)
def saxs_profile(spark, d):
    got = D.saxs(D.mean_image(_px(spark, d)), T.detector(spark))
    far = T.detector(spark).agg(F.max(D.distance()).alias("far"))
    every = spark.range(D.SAXS_BINS + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(far))
    return every.join(F.broadcast(got.drop("q")), "bin", "left").select("bin", rounded(F.col("bin") * F.col("far") / D.SAXS_BINS).alias("q"), rounded("v").alias("v"))


@_r.add(
    f"with {PX}, {DET}, w as (select panel, r, c, 1 / pow(abs(sqrt(qx * qx + qy * qy) * 1e-10), 2) as w from det), one as (select panel, r, c, w / sum(w) over () as w from w) "
    "select image_id, round(sum(w * v * v), 9) + 0.0 as power from px join one using (panel, r, c) group by 1"
)
def resolution_weights(spark, d):
    """The weighted mean square of every image."""
    w = D.resolution_weights(T.detector(spark), 2).select("panel", "r", "c", "w")  # a row for each pixel of the detector
    return _px(spark, d).join(F.broadcast(w), ["panel", "r", "c"]).groupBy("image_id").agg(rounded(F.sum(F.col("w") * F.col("v") * F.col("v")), 9).alias("power"))


_FACTOR = (
    f"with {PX}, {DET}, {_BINNED}, bright as (select image_id, panel, r, c, 64 * v * v as v from px), mi as (select panel, r, c, avg(v) as v from bright group by all), "
    "mean as (select bin, avg(v) as m from mi join q using (panel, r, c) group by 1), own as (select image_id, bin, avg(v) as v from bright join q using (panel, r, c) group by 1, 2), "
    "factors as (select image_id, avg(m / v) as factor from own join mean using (bin) where bin < 25 and v > 0.1 group by 1) "
)


@_r.add(_FACTOR + "select image_id, round(factor, 5) + 0.0 as factor from factors")
def fluctuation_scale(spark, d):
    return rounded_columns(D.fluctuation_factor(_bright(spark, d), T.detector(spark)), "factor", digits=5)


@_r.add(_FACTOR + "select image_id, round(sum(v * coalesce(factor, 1)), 4) + 0.0 as total from bright left join factors using (image_id) group by 1")
def fluctuation_rescale(spark, d):
    px = _bright(spark, d)
    return D.rescale(px, D.fluctuation_factor(px, T.detector(spark))).groupBy("image_id").agg(rounded(F.sum("v"), 4).alias("total"))


@_r.add(f"with {PX} select image_id, panel, r // 2 as r, c // 2 as c, round(sum(v), 6) + 0.0 as v from px group by all")
def bin_sum(spark, d):
    return rounded_columns(D.bin_pixels(_px(spark, d), 1, "sum"), "v")


@_r.add(f"with {PX} select image_id, panel, r // 4 as r, c // 4 as c, round(avg(v), 6) + 0.0 as v from px group by all")
def bin_mean(spark, d):
    return rounded_columns(D.bin_pixels(_px(spark, d), 2, "mean"), "v")


_PLACES = f"{PX}, places as (select image_id, panel, r, c, floor(1000 * (v + 1))::int as ix, floor(1000 * (1 - v))::int as iy from px)"


def _places(spark, d):
    """Maps of places: whole numbers made of each image's values."""
    v = F.col("v")
    return _px(spark, d).select("image_id", "panel", "r", "c", F.floor(1000 * (v + 1)).cast("int").alias("ix"), F.floor(1000 * (1 - v)).cast("int").alias("iy"))


@_r.add(f"with {_PLACES} select image_id, panel, r // 2 as r, c // 2 as c, min(ix) // 2 as ix, min(iy) // 2 as iy from places group by 1, 2, 3, 4")
def bin_index(spark, d):
    both = [D.bin_pixels(_places(spark, d), 1, "index", n) for n in ("ix", "iy")]
    return both[0].join(both[1], ["image_id", "panel", "r", "c"])


@_r.add(f"with {PX} select image_id, panel, r - 2 as r, c - 2 as c, round(v, 6) + 0.0 as v from px where r between 2 and 5 and c between 2 and 5")
def clip_mono(spark, d):
    return rounded_columns(D.clip(_px(spark, d), 1, 8, 8, 1), "v")


@_r.add(
    f"with {PX4} select image_id, panel, r - 2 as r, case when panel % 2 = 0 then c - 2 else c end as c, round(v, 6) + 0.0 as v from px4 "
    "where r >= 2 and ((panel % 2 = 0 and c >= 2) or (panel % 2 = 1 and c < 2))"
)
def clip_four_panel(spark, d):
    return rounded_columns(D.clip(_px4(spark, d), 1, 4, 4, 4), "v")


@_r.add(f"with {_PLACES}, k as (select image_id, panel, r - 2 as r, c - 2 as c, ix from places where r between 2 and 5 and c between 2 and 5) select image_id, panel, r, c, ix - min(ix) over () as ix from k")
def clip_index(spark, d):
    return D.clip_index(_places(spark, d), 1, 8, 8, 1, "ix").select("image_id", "panel", "r", "c", "ix")


@_r.add(f"with {PX} select image_id, panel, (r - 2) // 2 as r, (c - 2) // 2 as c, round(avg(v), 6) + 0.0 as v from px where r between 2 and 5 and c between 2 and 5 group by all")
def clip_and_bin(spark, d):
    return rounded_columns(D.bin_pixels(D.clip(_px(spark, d), 1, 8, 8, 1), 1, "mean"), "v")


@_r.add(f"with {PX}, {DET} select image_id, ix, iy, round(nullif(v, 0), 6) + 0.0 as v from px join det using (panel, r, c)")
def assemble_image(spark, d):
    return rounded_columns(D.assemble(_px(spark, d), T.detector(spark)), "v")


@_r.add(f"with {ORIENT}, {ROT} select image_id, {sql_columns(*[f'm{i}{j}' for i in range(3) for j in range(3)])} from rot")
def quat_rotmat(spark, d):
    m = Q.rotation_matrix(Q.quat())
    return T.orientations(spark, d).select("image_id", *[rounded(m[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)])


def _paired(spark, d):
    a = T.orientations(spark, d)
    b = a.select((F.col("image_id") - 1).alias("image_id"), *[F.col(n).alias(f"b{n}") for n in "wxyz"])
    return a.join(b, "image_id")


@_r.add(
    f"with {ORIENT}, p as (select a.image_id, a.w as p0, a.x as p1, a.y as p2, a.z as p3, b.w as r0, b.x as r1, b.y as r2, b.z as r3 from orient a join orient b on b.image_id = a.image_id + 1) "
    "select image_id, round(r0 * p0 - r1 * p1 - r2 * p2 - r3 * p3, 6) + 0.0 as w, round(r0 * p1 + r1 * p0 - r2 * p3 + r3 * p2, 6) + 0.0 as x, "
    "round(r0 * p2 + r1 * p3 + r2 * p0 - r3 * p1, 6) + 0.0 as y, round(r0 * p3 - r1 * p2 + r2 * p1 + r3 * p0, 6) + 0.0 as z from p"
)
def quat_product(spark, d):
    p = Q.product(Q.quat(), Q.quat("b"))
    return _paired(spark, d).select("image_id", *[rounded(x).alias(n) for n, x in zip("wxyz", p, strict=True)])


@_r.add(
    f"with {ORIENT}, n as (select *, sqrt(x * x + y * y + z * z) as s, 3 * w as angle from orient) select image_id, round(cos(angle / 2), 6) + 0.0 as w, "
    + ", ".join(f"round(sin(angle / 2) * {c} / s, 6) + 0.0 as {c}" for c in "xyz") + " from n"
)
def axis_angle_quat(spark, d):
    q = Q.axis_angle((F.col("x"), F.col("y"), F.col("z")), 3 * F.col("w"))
    return T.orientations(spark, d).select("image_id", *[rounded(x).alias(n) for n, x in zip("wxyz", q, strict=True)])


@_r.add(
    f"with {ORIENT}, s as (select *, case when w * w >= greatest(x * x, y * y, z * z) then sign(w) when x * x >= greatest(y * y, z * z) then sign(x) "
    f"when y * y >= z * z then sign(y) else sign(z) end as g from orient) select image_id, " + ", ".join(f"round(g * {c}, 5) + 0.0 as {c}" for c in "wxyz") + " from s"
)
def rotmat_quat(spark, d):
    m = Q.rotation_matrix(Q.quat())
    rot = T.orientations(spark, d).select("image_id", *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    q = Q.from_matrix([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    return rot.select("image_id", *[rounded(x, 5).alias(n) for n, x in zip("wxyz", q, strict=True)])


@_r.add(f"with {ORIENT}, {ROT}, {DET}, {HKL} select image_id, panel, r, c, {sql_columns('h', 'k', 'l')} from hkl")
def rotate_positions(spark, d):
    return rounded_columns(G.rotate_positions(T.orientations(spark, d), T.detector(spark)), "h", "k", "l")


_NORMAL = f"with {ORIENT}, {ROT}, {DET}, {HKL}, far as (select max(sqrt(qx * qx + qy * qy + qz * qz)) as f from det), nrm as (select image_id, panel, r, c, " + ", ".join(f"{x} * pi() / (f * 1.5) as {x}" for x in "hkl") + " from hkl cross join far) "


@_r.add(_NORMAL + f"select image_id, panel, r, c, {sql_columns('h', 'k', 'l')} from nrm")
def normalised_hkl(spark, d):
    det = T.detector(spark)
    return rounded_columns(G.normalise(G.rotate_positions(T.orientations(spark, d), det), det, 1.5), "h", "k", "l")


@_r.add(_NORMAL + "select round(max(greatest(abs(h), abs(k), abs(l))), 6) + 0.0 as largest, max(greatest(abs(h), abs(k), abs(l))) < 3 * pi() as inside from nrm")
def hkl_domain(spark, d):
    det = T.detector(spark)
    return rounded_columns(G.check_domain(G.normalise(G.rotate_positions(T.orientations(spark, d), det), det, 1.5)), "largest")


@_r.add(f"with {ORIENT}, {ROT}, {DET}, {HKL} select image_id, r, c, {sql_columns('h', 'k', 'l')} from hkl where abs(l) < 0.01 * (select max(sqrt(qx * qx + qy * qy + qz * qz)) from det)")
def star_filter(spark, d):
    det = T.detector(spark)
    far = det.agg(F.max(D.distance()).alias("far"))
    near = G.rotate_positions(T.orientations(spark, d), det).crossJoin(F.broadcast(far)).where(F.abs("l") < 0.01 * F.col("far"))
    return rounded_columns(near.select("image_id", "r", "c", "h", "k", "l"), "h", "k", "l")


@_r.add(
    f"with {VOL} select vol_id, i, j, k, round(i * (4.0::double / 3) - 2, 6) + 0.0 as x, round(j * (4.0::double / 3) - 2, 6) + 0.0 as y, round(k * (4.0::double / 3) - 2, 6) + 0.0 as z, round(v, 6) + 0.0 as v from vol"
)
def reciprocal_mesh(spark, d):
    """Every volume's voxels at their places of the mesh."""
    mesh = G.reciprocal_mesh(spark, T.CUBE, 2.0)  # n^3 rows
    return rounded_columns(T.voxels(T.wide(spark, d, "vol_id")).join(F.broadcast(mesh), ["i", "j", "k"]), "x", "y", "z", "v")


@_r.add("with e as (select vec_id, unnest(embedding)::double as v from embeddings) select round(stddev_pop(v) filter (vec_id % 20 = 0) / stddev_pop(v), 6) + 0.0 as factor from e")
def std_match_scale(spark, d):
    return spark.range(1).select(rounded(M.std_scale(_asked(spark, d), _refs(spark, d))).alias("factor"))


@_r.add(f"with {PAIRS} select image_id, ref_id, round(distance, 6) + 0.0 as distance from pairs")
def pair_distance(spark, d):
    return N.pair_distances(_asked(spark, d), _refs(spark, d), others=True, digits=6)


_BEST = f"with {PAIRS}, best as (select image_id, ref_id, distance, row_number() over (partition by image_id order by distance, ref_id) as rank from pairs) "


@_r.add(_BEST + "select image_id, ref_id, round(distance, 6) + 0.0 as distance from best where rank = 1")
def nearest_reference(spark, d):
    return rounded_columns(M.match(_asked(spark, d), _refs(spark, d), scale=False, others=True), "distance")


@_r.add(_BEST + "select image_id, ref_id, rank, round(distance, 6) + 0.0 as distance from best where rank <= 3")
def knn_topk(spark, d):
    return rounded_columns(N.k_nearest(_asked(spark, d), _refs(spark, d), 3, others=True), "distance")


@_r.add(_BEST + "select round(avg(distance), 6) + 0.0 as mean, round(stddev_pop(distance), 6) + 0.0 as std from best where rank = 1")
def match_quality(spark, d):
    return rounded_columns(M.quality(M.match(_asked(spark, d), _refs(spark, d), scale=False, others=True)), "mean", "std")


@_r.add(f"with {PAIRS} select image_id, arg_min(ref_id, weighted) as ref_id, round(min(weighted), 6) + 0.0 as distance from pairs group by 1")
def weighted_nearest(spark, d):
    got = N.k_nearest(_asked(spark, d), _refs(spark, d), 1, [1 / (1 + p) for p in range(64)], others=True)
    return rounded_columns(got.drop("rank"), "distance")


@_r.add(
    "with e as (select vec_id as id, unnest(embedding)::double as v, unnest(range(0, 64)) as p from embeddings), s as (select stddev_pop(v) filter (id % 20 = 0) / stddev_pop(v) as f from e), "
    "d as (select a.id as image_id, b.id as ref_id, sum((a.v - b.v * f) * (a.v - b.v * f)) as distance from e a join e b on a.p = b.p and a.id % 20 = 0 and b.id <> a.id cross join s group by 1, 2) "
    "select image_id, arg_min(ref_id, distance) as ref_id, round(min(distance), 6) + 0.0 as distance from d group by 1"
)
def scaled_match(spark, d):
    return rounded_columns(M.match(_asked(spark, d), _refs(spark, d), others=True), "distance")


@_r.add(
    f"with {ORIENT}, n as (select floor(0.75 * count(*)) as n from orient) select image_id, "
    + ", ".join(f"round(case when image_id < n then {v} else {c} end, 6) + 0.0 as {c}" for c, v in zip("wxyz", ("1.0", "0.0", "0.0", "0.0"), strict=True)) + " from orient cross join n"
)
def known_orientation_override(spark, d):
    orient = T.orientations(spark, d)
    known = orient.select("image_id", F.lit(1.0).alias("w"), *[F.lit(0.0).alias(n) for n in "xyz"])
    return rounded_columns(M.override_known(orient, known, 0.75, orient.count()), "w", "x", "y", "z")


@_r.add(
    f"with {DET}, p as (select panel, r, c, qx * 0.001 as x, qy * 0.001 as y, 0.1::double as z from det), n as (select *, sqrt(x * x + y * y + z * z) as s from p), "
    "e as (select vec_id as image_id, 9000 + 1000 * embedding[1]::double as ev from embeddings) select image_id, panel, r, c, "
    + ", ".join(f"round(({x} / s - {1 if x == 'z' else 0}) / (1.23984198e-6 / ev) / 1e6, 6) + 0.0 as q{x}" for x in "xyz") + " from n cross join e"
)
def energy_positions(spark, d):
    """Of every shot, at its own photon energy."""
    px = T.detector(spark).select("panel", "r", "c", (F.col("qx") * 0.001).alias("x"), (F.col("qy") * 0.001).alias("y"), F.lit(0.1).alias("z"))
    shots = T.wide(spark, d).select("image_id", (9000 + 1000 * F.col("data")[0]).alias("ev"))
    at = G.positions_from_energy(shots.join(F.broadcast(px), how="cross"), F.col("ev"))  # each shot with the fixed detector
    return at.select("image_id", "panel", "r", "c", *[rounded(F.col(f"q{n}") / 1e6).alias(f"q{n}") for n in "xyz"])


@_r.add("with e as (select event_id, row_number() over (order by event_id) - 1 as rank from events) select rank % 4 + 1 as worker, rank // 4 as slot, event_id from e where rank < 200")
def worker_fill(spark, d):
    return S.fill(T.table(spark, d, "events"), 4, 50).select("worker", "slot", "event_id")


@_r.add(
    "with e as (select event_id, row_number() over (order by event_id) - 1 as rank from events), n as (select count(*) as n from e), "
    "more as (select event_id, n - 1 + unnest(range(1, (300 - n % 300) % 300 + 1)) as rank from e, n where rank = n - 1) "
    "select rank // 300 as batch, rank % 300 as slot, event_id from (select * from e union all select * from more)"
)
def padded_batches(spark, d):
    return S.pad(T.table(spark, d, "events"), 300).select("batch", "slot", "event_id")


_RANK = "with e as (select *, row_number() over (order by event_id) - 1 as rank from events) "


@_r.add(_RANK + "select rank // 1000 as generation, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from e group by 1")
def stream_generation_trigger(spark, d):
    got = S.assign(T.table(spark, d, "events"), 1000).groupBy("generation")
    return got.agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@_r.add(
    _RANK + ", g as (select rank // 1000 as generation, count(value) as n, sum(value) as s from e group by 1) "
    "select generation, (sum(n) over (order by generation))::bigint as n, round(sum(s) over (order by generation) / sum(n) over (order by generation), 6) + 0.0 as mean from g"
)
def stream_cumulative_mean(spark, d):
    return rounded_columns(S.cumulative_mean(T.table(spark, d, "events"), 1000), "mean")


@_r.add(
    _RANK + "select case when rank < 500 then (rank + 1) // 100 - 1 else rank - 500 + 5 end as generation, rank as last_rank, least(rank + 1, 500) as n_seen from e "
    "where (rank < 500 and (rank + 1) % 100 = 0) or (rank >= 500 and rank - 500 + 5 < 20)"
)
def stream_cap_generations(spark, d):
    return S.capped(T.table(spark, d, "events"), 100, 500, 20)


# One line of a log for each event; times are whole hundredths of a second.
_TIME = "((event_id * 37 + round(value * 100)::bigint) % 900 + 100)"
_SECONDS = f"({_TIME} // 100)::varchar || '.' || lpad(({_TIME} % 100)::varchar, 2, '0') || 's'"
_LOG = (
    "lines as (select case event_id % 4 when 0 then 'rank ' || (event_id % 7)::varchar || ': AC recovered in ' || t || '.' when 1 then 'Phasing completed in ' || t || '.' "
    "when 2 then 'Orientation matching completed in ' || t || '. slice=' || t || '. match=' || t || '. slice_oh=0.01s. match_oh=0.02s.' else 'nothing to see' end as value "
    f"from (select event_id, {_SECONDS} as t from events where value is not null))"
)


def _log(events):
    time = F.pmod(F.col("event_id") * 37 + F.round(F.col("value") * 100).cast("long"), F.lit(900)) + 100
    t = F.concat(F.floor(time / 100).cast("string"), F.lit("."), F.lpad((time % 100).cast("string"), 2, "0"), F.lit("s"))
    kind = F.col("event_id") % 4
    line = F.when(kind == 0, F.concat(F.lit("rank "), (F.col("event_id") % 7).cast("string"), F.lit(": AC recovered in "), t, F.lit(".")))
    line = line.when(kind == 1, F.concat(F.lit("Phasing completed in "), t, F.lit(".")))
    line = line.when(kind == 2, F.concat(F.lit("Orientation matching completed in "), t, F.lit(". slice="), t, F.lit(". match="), t, F.lit(". slice_oh=0.01s. match_oh=0.02s.")))
    return events.where("value is not null").select(line.otherwise("nothing to see").alias("value"))


@_r.add(
    f"with {_LOG}, "
    f"found as (select 'stage' as kind, unnest(regexp_extract_all(value, '{reports.STAGE}', 1)) as stage, unnest(regexp_extract_all(value, '{reports.STAGE}', 2))::double as t from lines "
    f"union all select 'part', unnest(regexp_extract_all(value, '{reports.PART}', 1)), unnest(regexp_extract_all(value, '{reports.PART}', 2))::double from lines) "
    "select kind, stage, count(*) as n, max(t) as longest, min(t) as shortest, round(avg(t), 6) + 0.0 as mean, round(stddev_pop(t), 6) + 0.0 as std, round(sum(t) / 2, 6) + 0.0 as per_rank from found group by 1, 2"
)
def stage_timing_report(spark, d):
    """Of a log with a line for each event."""
    got = reports.stage_timings(_log(T.table(spark, d, "events")), 2)
    return rounded_columns(got, "mean", "std", "per_rank")
