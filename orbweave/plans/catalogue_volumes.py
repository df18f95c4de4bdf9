"""Queries over volumes: transforms, filters, merging, phasing and evaluation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import geometry as G
from ..operators import kernels as K
from ..operators import merging as A
from ..operators import phasing as P
from ..operators import slabs as S
from ..operators import tiles as W
from ..operators.detector import mean_image
from ..sources import pdb
from ..sources import tables as T
from .reconstruct import positions
from .registry import DET, HKL, ORIENT, PX, ROT, VOL, Registry, rounded, rounded_columns, sql_columns

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql
N = T.CUBE


def _wide(spark, d):
    return T.wide(spark, d, "vol_id")


def _long(df, **names):
    """Array columns of cubes as rounded voxels i, j, k."""
    cols = list(names)
    p = df.select("vol_id", F.posexplode(F.arrays_zip(*cols)).alias("p", "x"))
    at = {"i": F.floor(F.col("p") / (N * N)), "j": F.floor(F.col("p") / N) % N, "k": F.col("p") % N}
    return p.select("vol_id", *[e.cast("int").alias(n) for n, e in at.items()], *[rounded(F.col(f"x.{c}"), digits).alias(c if c != "data" else "v") for c, digits in names.items()])


#: Planes of a slab, here: volumes of four are cut in two, so that what is exchanged is.
THICK = N // 2


def _cut(spark, d):
    return S.cut(_wide(spark, d), N, THICK)


def _placed(slabs, digits: int):
    return rounded_columns(S.voxels(slabs, N, THICK, "v"), "v", digits=digits)


# A direct discrete transform: 64 products for each coefficient.
_T = "2 * pi() * (f.i * x.i + f.j * x.j + f.k * x.k) / 4"
DFT = (
    f"{VOL}, idx as (select distinct i, j, k from vol), "
    f"ft as (select vol_id, f.i, f.j, f.k, sum(v * cos({_T})) as re, -sum(v * sin({_T})) as im from vol x cross join idx f group by all)"
)


@_r.add(f"with {DFT} select vol_id, i, j, k, {sql_columns('re', 'im')} from ft")
def dft3(spark, d):
    return rounded_columns(S.voxels(S.forward(_cut(spark, d), N, THICK), N, THICK, "re", "im", pencils=True, complex_=True), "re", "im")


@_r.add(f"with {DFT} select f.vol_id, f.i, f.j, f.k, round(sqrt(re * re + im * im), 6) + 0.0 as intensity, round(v * v, 6) + 0.0 as squared from ft f join vol using (vol_id, i, j, k)")
def output_intensity(spark, d):
    """Of an autocorrelation: the intensity (its transform's size) and its square, voxel by voxel."""
    got = K.map_volumes(_wide(spark, d), lambda v: {"intensity": np.abs(np.fft.fftn(v, axes=(1, 2, 3))), "squared": v * v}, {"intensity": "array<double>", "squared": "array<double>"})
    return _long(got, intensity=6, squared=6)


_POINTS = (0.1, 0.2, -0.15)


@_r.add(
    f"with {VOL}, pt as (select a, 0.1::double * a as h, 0.2::double * a as k2, -0.15::double * a as l from (select unnest(range(1, 9)) as a)), "
    "s as (select vol_id, a, sum(v * cos(h * (i - 2) + k2 * (j - 2) + l * (k - 2))) as re, -sum(v * sin(h * (i - 2) + k2 * (j - 2) + l * (k - 2))) as im from vol cross join pt group by 1, 2) "
    f"select vol_id, a as point, {sql_columns('re', 'im')} from s"
)
def nufft_type2_direct(spark, d):
    a = np.arange(1, 9)

    def fn(v):
        got = np.stack([K.nufft2(x, *[a * p for p in _POINTS]) for x in v])
        return {"re": got.real, "im": got.imag}

    got = K.map_volumes(_wide(spark, d), fn, {"re": "array<double>", "im": "array<double>"})
    each = got.select("vol_id", F.posexplode(F.arrays_zip("re", "im")).alias("p", "x"))
    return each.select("vol_id", (F.col("p") + 1).alias("point"), rounded("x.re").alias("re"), rounded("x.im").alias("im"))


@_r.add(
    f"with {PX}, g as (select unnest(range(-1, 2))::int as a), t as (select image_id, x.a + 1 as i, y.a + 1 as j, z.a + 1 as k, "
    "sum(v * cos(0.1 * r * x.a + 0.2 * c * y.a + 0.05 * (r + c) * z.a)) as re, sum(v * sin(0.1 * r * x.a + 0.2 * c * y.a + 0.05 * (r + c) * z.a)) as im "
    f"from px cross join g x cross join g y cross join g z group by all) select image_id, i, j, k, {sql_columns('re', 'im')} from t"
)
def nufft_type1_direct(spark, d):
    r, c = np.divmod(np.arange(64), 8)

    def fn(v):
        got = np.stack([K.nufft1(x.ravel(), 0.1 * r, 0.2 * c, 0.05 * (r + c), 3) for x in v])
        return {"re": got.real, "im": got.imag}

    got = K.map_volumes(_wide(spark, d), fn, {"re": "array<double>", "im": "array<double>"})
    p = got.select(F.col("vol_id").alias("image_id"), F.posexplode(F.arrays_zip("re", "im")).alias("p", "x"))
    return p.select("image_id", F.floor(F.col("p") / 9).cast("int").alias("i"), (F.floor(F.col("p") / 3) % 3).cast("int").alias("j"), (F.col("p") % 3).cast("int").alias("k"), rounded("x.re").alias("re"), rounded("x.im").alias("im"))


@_r.add(
    f"with {DFT}, q as (select a, ((a + 2) % 4) * 2 * pi() / 3 - pi() as x from (select unnest(range(0, 4))::int as a)) "
    "select vol_id, round(sum(re * re + im * im) filter (round(sqrt(x.x * x.x + y.x * y.x + z.x * z.x), 4) > round(pi() / 1.5, 4)), 5) + 0.0 as outside, round(sum(re * re + im * im), 5) + 0.0 as power "
    "from ft join q x on x.a = i join q y on y.a = j join q z on z.a = k group by 1"
)
def antisupport_mask(spark, d):
    """How much of every volume's power lies outside the sampled ball."""
    half = N // 2
    mask = G.antisupport(spark, N, 1.5).select(*[F.pmod(F.col(c) - half, F.lit(N)).alias(c) for c in "ijk"], "outside")  # n^3 rows, origin first
    f = S.voxels(S.forward(_cut(spark, d), N, THICK), N, THICK, "re", "im", pencils=True, complex_=True).join(F.broadcast(mask), ["i", "j", "k"])
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return f.groupBy("vol_id").agg(rounded(F.sum(F.when(F.col("outside"), power)), 5).alias("outside"), rounded(F.sum(power), 5).alias("power"))


_ELEMENTS = ["N", "C", "O", "S", ""]


@_r.add(
    "with a as (select floor(1000 * embedding[1]::double) / 100 as x, floor(1000 * embedding[2]::double) / 100 as y, floor(1000 * embedding[3]::double) / 100 as z, "
    "case vec_id % 5 when 0 then 7 when 2 then 8 when 3 then 16 else 6 end as n from embeddings), "
    "m as (select avg(x) as mx, avg(y) as my, avg(z) as mz from a), p as (select n, (x - mx) / 1.0 + 4 as x, (y - my) / 1.0 + 4 as y, (z - mz) / 1.0 + 4 as z from a cross join m), "
    "s as (select unnest(range(0, 9))::int as a) "
    "select i.a as i, j.a as j, k.a as k, round(sum(n * exp(-((i.a - x) * (i.a - x) + (j.a - y) * (j.a - y) + (k.a - z) * (k.a - z)) / (2 * 0.64))), 5) + 0.0 as v "
    "from p cross join s i cross join s j cross join s k where abs(i.a - floor(x + 0.5)) <= 3 and abs(j.a - floor(y + 0.5)) <= 3 and abs(k.a - floor(z + 0.5)) <= 3 group by 1, 2, 3"
)
def atom_density(spark, d):
    """An atom for each vector of the table, as lines of the public format, read and added up."""
    at = [F.floor(1000 * F.col("data")[i]) / 100 for i in range(3)]
    element = F.element_at(F.array(*[F.lit(e) for e in _ELEMENTS]), (F.col("image_id") % 5 + 1).cast("int"))
    lines = T.wide(spark, d).select(F.format_string("ATOM  %5d  CA  GLY A%4d    %8.3f%8.3f%8.3f  1.00  0.00          %2s", F.col("image_id") % 99999, F.col("image_id") % 9999, *at, element).alias("value"))
    return rounded_columns(pdb.density(pdb.parse(lines), 9, 1.0, 0.8), "v", digits=5)


@_r.add(
    "with atoms as (select 5 * embedding[1]::double as x, 5 * embedding[2]::double as y, 5 * embedding[3]::double as z, (6 + vec_id % 3)::double as e from embeddings), "
    "about as (select x - avg(x) over () as x, y - avg(y) over () as y, z - avg(z) over () as z, e from atoms), "
    "s as (select unnest(range(0, 5))::int as p), q as (select a.p as a, b.p as b, c.p as c from s a cross join s b cross join s c), "
    "f as (select a, b, c, sum(e * cos((a - 2) * x + (b - 2) * y + (c - 2) * z)) as re, sum(e * sin((a - 2) * x + (b - 2) * y + (c - 2) * z)) as im from q cross join about group by 1, 2, 3) "
    "select i.p as i, j.p as j, k.p as k, round(sum(re * cos(2 * pi() * ((a - 2) * (i.p - 2) + (b - 2) * (j.p - 2) + (c - 2) * (k.p - 2)) / 5) "
    "- im * sin(2 * pi() * ((a - 2) * (i.p - 2) + (b - 2) * (j.p - 2) + (c - 2) * (k.p - 2)) / 5)) / 125, 5) + 0.0 as v from s i cross join s j cross join s k cross join f group by 1, 2, 3"
)
def reference_density(spark, d):
    """From the diffraction of an atom for each vector of the table."""
    atoms = T.wide(spark, d).select(*[(5 * F.col("data")[i]).alias(c) for i, c in enumerate("xyz")], (6 + F.col("image_id") % 3).cast("double").alias("electrons"))
    return rounded_columns(pdb.reference_density(atoms, 5, 2.0), "v", digits=5)


# Frequencies of a side of 4 that lie outside the ball, with the origin first; and what they make of an impulse.
_OUT = (
    "s4 as (select unnest(range(0, 4))::int as a), fq as (select a, ((a + 2) % 4) * 2 * pi() / 3 - pi() as q from s4), "
    "outside as (select x.a as i, y.a as j, z.a as k from fq x cross join fq y cross join fq z where round(sqrt(x.q * x.q + y.q * y.q + z.q * z.q), 4) > round(pi(), 4)), "
    "reg as (select x.a as i, y.a as j, z.a as k, coalesce(sum(cos(2 * pi() * (f.i * x.a + f.j * y.a + f.k * z.a) / 4)), 0) / 64 as g from s4 x cross join s4 y cross join s4 z cross join outside f group by 1, 2, 3)"
)


@_r.add(
    f"with {VOL}, {_OUT}, idx as (select distinct i, j, k from vol) select o.vol_id, r.i, r.j, r.k, round(sum(o.v * g.g), 6) + 0.0 as v from vol o cross join idx r "
    "join reg g on g.i = (r.i - o.i + 4) % 4 and g.j = (r.j - o.j + 4) % 4 and g.k = (r.k - o.k + 4) % 4 group by 1, 2, 3, 4"
)
def fourier_regulariser(spark, d):
    return _placed(S.fourier_reg(_cut(spark, d), A.outside_ball(N, 1.0), N, THICK), 6)


def _kernel() -> np.ndarray:
    a = np.arange(1, 9)
    return K.nufft1(np.ones(8, dtype=complex), *[a * p for p in _POINTS], 2 * N).real


_AHA = (
    "idx as (select distinct i, j, k from vol), d7 as (select unnest(range(-3, 4))::int as a), pt as (select unnest(range(1, 9)) as a), "
    "ker as (select x.a as i, y.a as j, z.a as k, sum(cos(0.1 * p.a * x.a + 0.2 * p.a * y.a - 0.15 * p.a * z.a)) as g from d7 x cross join d7 y cross join d7 z cross join pt p group by 1, 2, 3)"
)


@_r.add(f"with {VOL}, {_AHA} select o.vol_id, r.i, r.j, r.k, round(sum(o.v * g.g), 5) + 0.0 as v from vol o cross join idx r join ker g on g.i = r.i - o.i and g.j = r.j - o.j and g.k = r.k - o.k group by 1, 2, 3, 4")
def aha_convolution(spark, d):
    return _placed(S.convolve(_cut(spark, d), A.kernel_transform(_kernel()), N, THICK), 5)


_RL, _FL = 0.5, 2.0
_W = (
    f"{VOL}, {_AHA}, {_OUT}, w as (select r.i as i, r.j as j, r.k as k, o.i as oi, o.j as oj, o.k as ok, "
    f"c.g + {_FL} * g.g + case when r.i = o.i and r.j = o.j and r.k = o.k then {_RL} else 0 end as m from idx r cross join idx o "
    "join ker c on c.i = r.i - o.i and c.j = r.j - o.j and c.k = r.k - o.k join reg g on g.i = (r.i - o.i + 4) % 4 and g.j = (r.j - o.j + 4) % 4 and g.k = (r.k - o.k + 4) % 4)"
)


def _w(name: str, source: str) -> str:
    return f"{name} as (select u.vol_id, w.i, w.j, w.k, sum(w.m * u.v) as v from {source} u join w on u.i = w.oi and u.j = w.oj and u.k = w.ok group by 1, 2, 3, 4)"


def _apply():
    one = np.ones((N, N, N))
    return A.normal_operator(A.kernel_transform(_kernel()), one, A.outside_ball(N, 1.0), _RL, _FL)


@_r.add(f"with {_W}, {_w('wu', 'vol')} select vol_id, i, j, k, round(v, 5) + 0.0 as v from wu")
def normal_op_apply(spark, d):
    apply = _apply()
    return _long(K.map_volumes(_wide(spark, d), lambda v: {"data": apply(v)}, {"data": "array<double>"}), data=5)


_KEY = "using (vol_id, i, j, k)"


@_r.add(
    f"with {_W}, {_w('w0', 'vol')}, a0 as (select vol_id, sum(v.v * v.v) / sum(v.v * w0.v) as a, sum(v.v * v.v) as rr from vol v join w0 {_KEY} group by 1), "
    f"r1 as (select vol_id, i, j, k, v.v - a * w0.v as v from vol v join w0 {_KEY} join a0 using (vol_id)), "
    "b0 as (select vol_id, sum(v * v) as rr1 from r1 group by 1), "
    f"p1 as (select vol_id, i, j, k, r1.v + rr1 / rr * v.v as v from r1 join vol v {_KEY} join b0 using (vol_id) join a0 using (vol_id)), "
    f"{_w('w1', 'p1')}, a1 as (select vol_id, any_value(rr1) / sum(p1.v * w1.v) as a2 from p1 join w1 {_KEY} join b0 using (vol_id) group by 1) "
    f"select vol_id, i, j, k, round(a * v.v + a2 * p1.v, 5) + 0.0 as v from vol v join p1 {_KEY} join a0 using (vol_id) join a1 using (vol_id)"
)
def cg_two_steps(spark, d):
    kernel, outside = A.kernel_transform(_kernel()), A.outside_ball(N, 1.0)
    return _placed(S.conjugate_gradient(lambda p: S.normal_product(p, kernel, outside, _RL, _FL, N, THICK), _cut(spark, d), N, THICK, 2), 5)


def _gauss_sql(sigma: float, at: str, source: str = "vol") -> str:
    w = K.gauss_weights(sigma, 2.0 if sigma == 1 else 4.0)
    rows = ", ".join(f"({i - len(w) // 2}, {x!r}::double)" for i, x in enumerate(w.tolist()))
    take = {
        "wrap": "({c} + {s}.d + 4) % 4",
        "reflect": "case when {c} + {s}.d < 0 then -({c} + {s}.d) - 1 when {c} + {s}.d > 3 then 7 - ({c} + {s}.d) else {c} + {s}.d end",
        "constant": "{c} + {s}.d",
    }[at]
    on = " and ".join(f"o.{c} = {take.format(c='r.' + c, s=s)}" for c, s in zip("ijk", ("wi", "wj", "wk"), strict=True))
    value = "coalesce(sum(o.v * wi.w * wj.w * wk.w), 0)"
    return (
        f"gw(d, w) as (values {rows}), smooth as (select r.vol_id, r.i, r.j, r.k, {value} as v from {source} r cross join gw wi cross join gw wj cross join gw wk "
        f"left join {source} o on o.vol_id = r.vol_id and {on} group by 1, 2, 3, 4)"
    )


def _smooth(mode: str, sigma: float):
    def query(spark, d):
        return _placed(S.gauss(_cut(spark, d), N, THICK, sigma, mode, 2.0 if sigma == 1 else 4.0), 6)

    query.__name__ = f"gauss_smooth_{mode}"
    return query


for _mode, _sigma in (("reflect", 0.5), ("constant", 1.0), ("wrap", 1.0)):
    _r.add(f"with {VOL}, {_gauss_sql(_sigma, _mode)} select vol_id, i, j, k, round(v, 6) + 0.0 as v from smooth")(_smooth(_mode, _sigma))


@_r.add(f"with {VOL} select vol_id, i, j, k, round(v, 6) + 0.0 as v from vol where i = 2 or j = 2 or k = 2")
def volume_planes(spark, d):
    return rounded_columns(T.voxels(_wide(spark, d)).where("i = 2 or j = 2 or k = 2"), "v")


@_r.add(f"with {VOL} select vol_id, 3 - i as i, 3 - j as j, 3 - k as k, round(v, 6) + 0.0 as v from vol")
def flip_volume(spark, d):
    return rounded_columns(T.voxels(_wide(spark, d)).withColumns({c: 3 - F.col(c) for c in "ijk"}), "v")


_TURN = (math.cos(0.3), math.sin(0.3) / 3, 2 * math.sin(0.3) / 3, 2 * math.sin(0.3) / 3)


def _turned() -> str:
    m = K.matrix_of(np.array(_TURN)).tolist()
    row = lambda a: f"{m[a][0]!r}::double * (j - 2) + {m[a][1]!r}::double * (i - 2) + {m[a][2]!r}::double * (k - 2) + 2"
    # the first axis of a volume is y, the second x
    at = f"spot as (select i, j, k, {row(1)} as y, {row(0)} as x, {row(2)} as z from idx)"
    corner = "c2 as (select unnest([0, 1])::int as a)"
    weight = " * ".join(f"case when {n}.a = 1 then {c} - floor({c}) else 1 - ({c} - floor({c})) end" for n, c in (("cy", "y"), ("cx", "x"), ("cz", "z")))
    return (
        f"with {VOL}, idx as (select distinct i, j, k from vol), {at}, {corner}, "
        f"wt as (select spot.i, spot.j, spot.k, floor(y)::int + cy.a as oi, floor(x)::int + cx.a as oj, floor(z)::int + cz.a as ok, {weight} as w from spot cross join c2 cy cross join c2 cx cross join c2 cz "
        "where y between 0 and 3 and x between 0 and 3 and z between 0 and 3), "
        "got as (select v.vol_id, wt.i, wt.j, wt.k, sum(wt.w * v.v) as v from wt join vol v on v.i = oi and v.j = oj and v.k = ok group by 1, 2, 3, 4) "
        "select a.vol_id, a.i, a.j, a.k, round(coalesce(g.v, 0), 6) + 0.0 as v from vol a left join got g on g.vol_id = a.vol_id and g.i = a.i and g.j = a.j and g.k = a.k"
    )


@_r.add(_turned())
def rotate_volume_trilinear(spark, d):
    m = K.matrix_of(np.array(_TURN))
    return _long(K.map_volumes(_wide(spark, d), lambda v: {"data": np.stack([K.rotate(x, m) for x in v])}, {"data": "array<double>"}), data=6)


@_r.add(f"with {VOL}, {_gauss_sql(0.5, 'reflect')} select vol_id, count(*) filter (v > 1e-12) as inside from smooth group by 1")
def ac_support(spark, d):
    got = K.map_volumes(_wide(spark, d), lambda v: {"inside": (K.gauss(v, 0.5, "reflect") > 1e-12).sum(axis=(1, 2, 3))}, {"inside": "long"})
    return got


@_r.add(
    "with n as (select sum(len(embedding)) as n from embeddings) select k as member, round(9.0 * 9 * 9 / n * pow(2.0, k - 4.0), 9) + 0.0 as rlambda, 1e5::double * pow(10.0, k - 4) as flambda "
    "from (select unnest(range(0, 8))::int as k) cross join n"
)
def lambda_grid(spark, d):
    """For all values of the table's images, merged on a cube of side nine."""
    n = _wide(spark, d).agg(F.sum(F.size("data"))).first()[0]
    return A.lambda_grid(spark, 8, n, 9).select("member", rounded("rlambda", 9).alias("rlambda"), "flambda")


def _solved(spark, d):
    """Norms and residuals of ten members, by label."""
    e = T.table(spark, d, "embeddings").select(F.col("label").alias("member"), F.explode("embedding").alias("v")).select("member", F.col("v").cast("double").alias("v"))
    by = e.groupBy("member").agg(F.sum(F.abs("v")).alias("v1"), F.abs(F.sum("v")).alias("v2"))
    return by.join(F.broadcast(A.lambda_grid(spark, 10, 1000, 9)), "member")


_SOLVED = (
    "with e as (select label as member, unnest(embedding)::double as v from embeddings), s as (select member, sum(abs(v)) as v1, abs(sum(v)) as v2, "
    "729.0 / 1000 * pow(2.0, member - 5.0) as rlambda from e group by 1) "
)


@_r.add(_SOLVED + "select member from s where v1 >= (select avg(v1) from s) order by rlambda desc limit 1")
def lcurve_select_gen0(spark, d):
    return A.select_first(_solved(spark, d))


@_r.add(_SOLVED + "select member from s order by v1 + v2, member limit 1")
def lcurve_select(spark, d):
    return A.select_corner(_solved(spark, d))


@_r.add(f"with {VOL}, top as (select vol_id, max(v) as m from vol group by 1) select vol_id, count(*) as inside, sum(16 * i + 4 * j + k)::bigint as places from vol join top using (vol_id) where v > 0.01 * m and i in (0, 3) and j in (0, 3) and k in (0, 3) group by 1")
def initial_support(spark, d):
    got = P.initial_support(_wide(spark, d), 1)
    p = got.select("vol_id", F.posexplode("data").alias("p", "v")).where("v > 0")
    return p.groupBy("vol_id").agg(F.count("*").alias("inside"), F.sum("p").alias("places"))


_IMPOSED = (
    f"{DFT}, md as (select vol_id, i, j, k, case when i = 0 and j = 0 and k = 0 then re when re = 0 and im = 0 then 0.5 else 0.5 * re / sqrt(re * re + im * im) end as re, "
    "case when i = 0 and j = 0 and k = 0 then im when re = 0 and im = 0 then 0 else 0.5 * im / sqrt(re * re + im * im) end as im from ft), "
    f"new as (select vol_id, x.i, x.j, x.k, sum(f.re * cos({_T}) - f.im * sin({_T})) / 64 as v from md f cross join idx x group by all)"
)


@_r.add(f"with {_IMPOSED} select vol_id, i, j, k, round(case when v > 0 then v else 0 end, 6) + 0.0 as v from new")
def er_step(spark, d):
    return _placed(S.step(_cut(spark, d), N, THICK, 0.5), 6)


@_r.add(f"with {_IMPOSED} select vol_id, i, j, k, round(case when n.v > 0 then n.v else o.v - 0.3 * n.v end, 6) + 0.0 as v from new n join vol o using (vol_id, i, j, k)")
def hio_step(spark, d):
    return _placed(S.step(_cut(spark, d), N, THICK, 0.5, beta=0.3), 6)


_ABS = f"{VOL}, size as (select vol_id, i, j, k, abs(v) as v from vol), {_gauss_sql(1.0, 'wrap', 'size')}"


@_r.add(f"with {_ABS}, lv as (select vol_id, stddev_pop(v) as s from smooth group by 1) select vol_id, i, j, k, (v > 4 * s)::int::double as v from smooth join lv using (vol_id)")
def shrinkwrap_std(spark, d):
    return _placed(S.shrink_wrap(_cut(spark, d), N, THICK, "std", 4.0), 1)


@_r.add(f"with {_ABS}, lv as (select vol_id, max(v) as m from size group by 1) select vol_id, i, j, k, (v > 0.4 * m)::int::double as v from smooth join lv using (vol_id)")
def shrinkwrap_max(spark, d):
    return _placed(S.shrink_wrap(_cut(spark, d), N, THICK, "max", 1.0, 0.4), 1)


# Voxel centres of a side of 4 with the origin first: 1/4, 3/4, -3/4, -1/4.
_COM = (
    f"{VOL}, off(a, x) as (values (0, 0.25::double), (1, 0.75::double), (2, -0.75::double), (3, -0.25::double)), "
    + "com as (select vol_id, " + ", ".join(f"round_even(sum(abs(v) * o{c}.x) / sum(abs(v)) * 4 / 2, 0) + 0.0 as s{c}" for c in "ijk")
    + " from vol join off oi on oi.a = i join off oj on oj.a = j join off ok on ok.a = k group by 1)"
)


@_r.add(f"with {_COM} select vol_id, si, sj, sk from com")
def center_of_mass(spark, d):
    return rounded_columns(P.center_of_mass(T.voxels(_wide(spark, d)), N), "si", "sj", "sk")


@_r.add(f"with {_COM} select vol_id, " + ", ".join(f"((i - s{c}::int + 8) % 4)::int as {c}".replace("(i -", f"({c} -") for c in "ijk") + ", round(v, 6) + 0.0 as v from vol join com using (vol_id)")
def recenter(spark, d):
    return rounded_columns(P.recenter(T.voxels(_wide(spark, d)), N), "v")


@_r.add(
    f"with {VOL}, s as (select a.vol_id, (b.i - a.i + 4) % 4 as i, (b.j - a.j + 4) % 4 as j, (b.k - a.k + 4) % 4 as k, sum(a.v * b.v) as v from vol a join vol b using (vol_id) group by 1, 2, 3, 4) "
    "select vol_id, i, j, k, round(abs(v), 6) + 0.0 as v from s"
)
def density_autocorrelation(spark, d):
    return _placed(S.autocorrelation(_cut(spark, d), N, THICK), 6)


_HIST = (
    f"with {VOL}, pos as (select vol_id, v from vol where v > 0), ends as (select vol_id, case when min(v) = max(v) then min(v) - 0.5 else min(v) end as low, "
    "case when min(v) = max(v) then max(v) + 0.5 else max(v) end as high from pos group by 1), "
    "got as (select vol_id, least(floor((v - low) / ((high - low) / 200)), 199)::int as bin, count(*) as n from pos join ends using (vol_id) group by 1, 2), "
    "hist as (select e.vol_id, b as bin, coalesce(n, 0) as n from ends e cross join (select unnest(range(0, 200))::int as b) left join got g on g.vol_id = e.vol_id and g.bin = b), "
    "mo as (select vol_id, avg(n) as m from hist group by 1), "
    "sk as (select vol_id, avg(pow(n - m, 3)) / pow(avg(pow(n - m, 2)), 1.5) as skew from hist join mo using (vol_id) group by 1) "
)


@_r.add(_HIST + "select vol_id, bin, n from hist")
def hist200(spark, d):
    return P.histogram(T.voxels(_wide(spark, d)))


@_r.add(_HIST + "select vol_id, round(skew, 6) + 0.0 as skew from sk")
def hist_skew(spark, d):
    return rounded_columns(P.histogram_skew(P.histogram(T.voxels(_wide(spark, d)))), "skew")


@_r.add(_HIST + "select vol_id from sk order by round(skew, 9), vol_id limit 1")
def min_skew_member(spark, d):
    skews = P.histogram_skew(P.histogram(T.voxels(_wide(spark, d))))
    return P.least_skew(skews.withColumn("skew", F.round("skew", 9)))


@_r.add(f"with {PX}, m as (select panel, r, c, avg(v) as m from px group by all) select image_id, round(corr(v, m), 6) + 0.0 as cc from px join m using (panel, r, c) group by 1")
def pearson_cc(spark, d):
    px = T.pixels(T.wide(spark, d))
    return rounded_columns(E.pearson(px, F.broadcast(mean_image(px)), ["panel", "r", "c"], "image_id"), "cc")


def _curve(spark, d):
    f = E.fourier(_wide(spark, d)).withColumn("pair", F.floor(F.col("vol_id") / 2))
    halves = [f.where(F.col("vol_id") % 2 == n).select("pair", F.col("re").alias(f"re{n + 1}"), F.col("im").alias(f"im{n + 1}")) for n in (0, 1)]
    return E.shell_correlation(halves[0].join(halves[1], "pair"), N, 1.0, 0.3)


_FSC = (
    f"with {DFT}, fr as (select vol_id, ((i + 2) % 4) * (2.0::double / 3) - 1 as x, ((j + 2) % 4) * (2.0::double / 3) - 1 as y, ((k + 2) % 4) * (2.0::double / 3) - 1 as z, i, j, k, re, im from ft), "
    "two as (select a.vol_id // 2 as pair, sqrt(a.x * a.x + a.y * a.y + a.z * a.z) as s, a.re as re1, a.im as im1, b.re as re2, b.im as im2 from fr a join fr b on b.vol_id = a.vol_id + 1 and a.i = b.i and a.j = b.j and a.k = b.k where a.vol_id % 2 = 0), "
    "curve as (select pair, floor(s / 0.3)::int as shell, (floor(s / 0.3)::int + 0.5) * 0.3::double as r, "
    "sum(re1 * re2 + im1 * im2) / sqrt(sum(re1 * re1 + im1 * im1) * sum(re2 * re2 + im2 * im2)) as fsc from two where floor(s / 0.3) * 0.3 < 1.0 and s > floor(s / 0.3) * 0.3 group by 1, 2) "
)


@_r.add(_FSC + "select pair, shell, round(r, 6) + 0.0 as r, round(fsc, 5) + 0.0 as fsc from curve")
def fsc_curve(spark, d):
    got = _curve(spark, d)
    return got.select("pair", "shell", rounded("r").alias("r"), rounded("fsc", 5).alias("fsc"))


@_r.add(
    _FSC + ", rise as (select pair, fsc, r, lead(fsc) over (partition by pair order by fsc, r) as f2, lead(r) over (partition by pair order by fsc, r) as r2 from curve), "
    "hit as (select pair, min(case when fsc <= 0.5 and f2 > 0.5 then r + (0.5 - fsc) / (f2 - fsc) * (r2 - r) end) as r from rise group by 1) "
    "select pair, round(coalesce(1 / r, -1), 4) + 0.0 as resolution from hit"
)
def fsc_resolution(spark, d):
    return rounded_columns(E.resolution(_curve(spark, d)), "resolution", digits=4)


@_r.add(
    "with h as (select label as generation, 0.5 + avg(embedding[1]::double) as cc from embeddings group by 1), l as (select *, cc - lag(cc, 1, 0.0) over (order by generation) as delta_cc from h) "
    "select generation, round(cc, 6) + 0.0 as cc, round(delta_cc, 6) + 0.0 as delta_cc, cc > 0.49 and delta_cc < 0.01 as converged from l"
)
def convergence_flags(spark, d):
    h = T.table(spark, d, "embeddings").groupBy(F.col("label").alias("generation")).agg((0.5 + F.avg(F.col("embedding")[0].cast("double"))).alias("cc"))
    return rounded_columns(E.convergence(h, 0.49, 0.01), "cc", "delta_cc")


_SIDE = 6


@_r.add(
    f"with {PX}, {DET}, {ORIENT}, {ROT}, {HKL}, far as (select max(sqrt(qx * qx + qy * qy + qz * qz)) as far from det), "
    "place as (select image_id, r, c, h * pi() / far as h, k * pi() / far as k, l * pi() / far as l from hkl cross join far), s as (select unnest(range(0, 6))::int as a) "
    "select x.a as i, y.a as j, z.a as k, round(sum(v * cos(p.h * (x.a - 3) + p.k * (y.a - 3) + p.l * (z.a - 3))), 4) + 0.0 as v "
    "from px join place p using (image_id, r, c) cross join s x cross join s y cross join s z group by 1, 2, 3"
)
def nufft_type1_tiled(spark, d):
    """Every pixel of every image, at its place in the volume, gridded over slabs."""
    images = T.wide(spark, d, "image_id").join(T.orientations(spark, d).select("image_id", F.array(*"wxyz").alias("q")), "image_id")
    points = W.points_of(images.withColumn("member", F.lit(0)), positions(T.detector(spark), 1.0))
    return rounded_columns(S.voxels(W.type1(points, _SIDE, 3, 2), _SIDE, 2, "v").select("i", "j", "k", "v"), "v", digits=4)
