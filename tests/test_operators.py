"""Operators on small inline tables: exact results, ties, gaps, empty tables, and a run that is resumed."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.operators import detector as D
from orbweave.operators import evaluation as E
from orbweave.operators import kernels as K
from orbweave.operators import matching as M
from orbweave.operators import nearest as N
from orbweave.operators import merging as A
from orbweave.operators import phasing as P
from orbweave.plans import catalogue_runs as C
from orbweave.plans import reconstruct as R
from orbweave.plans.settings import Settings, load
from orbweave.sources import tables as T
from orbweave.streaming import generations as S

def synthetic_slices(spark, images: int, oversampling: float = 1.0, seed: int = 1):
    """image_id, q, data: diffraction images of the two blobs at known orientations, on the 8 x 8 detector."""
    det = R.positions(T.detector(spark), oversampling)
    ac = np.fft.fftshift(K.autocorrelation(np.fft.ifftshift(C.two_blobs())))

    def run(batches):
        for b in batches:
            data = []
            for q in b.column(1).to_pylist():
                h, k, l = K.matrix_of(np.array(q)).T @ det
                data.append(K.nufft2(ac, h, k, l).real)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(data, pa.list_(pa.float64()))], names=["image_id", "q", "data"])

    ids = R.random_orientations(spark.range(0, images, 1, 8).withColumnRenamed("id", "image_id"), seed)
    return ids.mapInArrow(run, "image_id long, q array<double>, data array<double>")


PX = "image_id long, panel int, r int, c int, v double"


def four_panels(spark):
    rows = [(0, p, r, c, float(100 * p + 10 * r + c)) for p in range(4) for r in range(8) for c in range(8)]
    return spark.createDataFrame(rows, PX)


def test_clip_and_bin_are_exact(spark):
    got = {(r["panel"], r["r"], r["c"]): r["v"] for r in D.clip(four_panels(spark), 1, 8, 8, 4).collect()}
    assert len(got) == 64 and got[0, 0, 0] == 44 and got[1, 0, 0] == 140 and got[3, 3, 3] == 373
    binned = {(r["panel"], r["r"], r["c"]): r["v"] for r in D.bin_pixels(four_panels(spark), 1, "mean").collect()}
    assert binned[2, 0, 0] == 205.5 and len(binned) == 64
    twice = D.bin_pixels(D.bin_pixels(four_panels(spark), 1, "sum"), 1, "sum").collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, D.bin_pixels(four_panels(spark), 2, "sum").collect()))
    with pytest.raises(ValueError):
        D.clip(four_panels(spark), 1, 8, 8, 3)


def test_range_scan_guards_its_count(spark):
    images = spark.range(10).select(F.col("id").alias("image_id"))
    assert T.range_scan(images, 2, 5).count() == 3
    with pytest.raises(ValueError):
        T.range_scan(images, 8, 12)


def test_ties_go_to_the_lower_reference(spark):
    refs = spark.createDataFrame([(7, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [5.0, 5.0])], "ref_id long, data array<double>")
    images = spark.createDataFrame([(0, [1.0, 0.0]), (1, [4.0, 4.0])], "image_id long, data array<double>")
    assert {r["image_id"]: r["ref_id"] for r in M.match(images, refs, scale=False).collect()} == {0: 3, 1: 9}
    assert M.match(images.limit(0), refs, scale=False).count() == 0
    assert N.k_nearest(images, refs.limit(0)).count() == 0


def test_selection_rules(spark):
    cols = "member int, rlambda double, v1 double, v2 double"
    tie = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 4.0, 2.0, 3.0), (2, 2.0, 2.0, 3.0)], cols)
    assert A.select_first(tie).first()["member"] == 1 and A.select_corner(tie).first()["member"] == 0
    some = spark.createDataFrame([(0, 9.0, 1.0, 0.0), (1, 1.0, 5.0, 5.0), (2, 2.0, 6.0, 1.0)], cols)
    assert A.select_first(some).first()["member"] == 2 and A.select_corner(some).first()["member"] == 0


def test_gaps_in_profiles_and_histograms(spark):
    det = T.detector(spark)
    one = spark.createDataFrame([(0, 0, 0, 0, 2.0)], PX)
    got = D.saxs(one, det).collect()
    assert [(r["bin"], r["v"]) for r in got] == [(100, 2.0)]
    flat = spark.createDataFrame([(0, 0, 0, 0, 3.0), (0, 0, 0, 1, 3.0), (1, 0, 0, 0, -1.0)], "vol_id long, i int, j int, k int, v double")
    hist = P.histogram(flat)
    assert hist.where("n > 0").collect()[0]["n"] == 2 and hist.count() == 200
    assert P.center_of_mass(flat.withColumn("v", F.lit(0.0)), 4).first()["si"] is None
    assert P.recenter(flat.withColumn("v", F.lit(0.0)), 4).count() == 3


def test_rescale_keeps_images_without_a_factor(spark):
    px = spark.createDataFrame([(0, 0, 0, 0, 2.0), (1, 0, 0, 0, 3.0)], PX)
    factors = spark.createDataFrame([(0, 2.0)], "image_id long, factor double")
    assert sorted(r["v"] for r in D.rescale(px, factors).collect()) == [3.0, 4.0]


def test_fsc_of_a_volume_with_itself_is_one(spark):
    flat = [float(x) for x in C.two_blobs(9).ravel()]
    f = E.fourier(spark.createDataFrame([(0, flat)], "vol_id long, data array<double>"))
    pair = f.select(F.lit(0).alias("pair"), *[F.col(c).alias(c + n) for n in "12" for c in ("re", "im")])
    rows = E.shell_correlation(pair, 9, 1.0, 0.13).collect()
    assert rows and all(abs(r["fsc"] - 1) < 1e-9 for r in rows)
    assert E.resolution(E.shell_correlation(pair, 9, 1.0, 0.13)).first()["resolution"] == -1


def test_convergence_sign(spark):
    h = spark.createDataFrame([(0, 0.9), (1, 0.5), (2, 0.85)], "generation int, cc double")
    assert [r["converged"] for r in E.convergence(h, 0.4, 0.1).orderBy("generation").collect()] == [False, True, False]
    assert [r["converged"] for r in E.convergence(h, 0.4, 0.1, absolute=True).orderBy("generation").collect()] == [False, False, False]


def test_parallel_grids_equal_one_pass(spark):
    images = synthetic_slices(spark, 40).withColumn("member", F.lit(0))
    det = R.positions(T.detector(spark), 1.0)

    def grids(df):
        rows = A.normal_grids(df, det, 5).collect()
        return {(r["part"], r["slab"]): np.array(r["data"]) for r in rows}

    a, b = grids(images.coalesce(1)), grids(images.repartition(7))
    assert a.keys() == b.keys() and len(a) == 15 and all(np.allclose(a[k], b[k]) for k in a)


def test_resume_equals_a_continuous_run(spark, tmp_path):
    images = synthetic_slices(spark, 40).select("image_id", "data")
    base = dict(side=5, n_orientations=30, n_phase_loops=1, n_er=2, n_hio=1, members=2, solve_steps=15)
    whole = R.run(spark, images, T.detector(spark), Settings(n_generations=3, out=str(tmp_path / "a"), **base))
    R.run(spark, images, T.detector(spark), Settings(n_generations=2, out=str(tmp_path / "b"), **base))
    assert R.saved_generations(spark, str(tmp_path / "b")) == [0, 1]
    again = R.run(spark, images, T.detector(spark), Settings(n_generations=3, out=str(tmp_path / "b"), **base), resume=True)
    assert again.generation == 2 and np.allclose(again.rho, whole.rho)


def test_convergence_needs_a_reference(spark):
    with pytest.raises(ValueError):
        R.run(spark, spark.range(1).selectExpr("id image_id", "array(1D) data"), T.detector(spark), Settings(check_convergence=True))


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('[algorithm]\noversampling = 2.0\nmembers = 8\n[detector]\nshape = [4, 512, 512]\n[runtime]\nn_clipping = 1\nn_binning = 4\n')
    s = load(f, ["algorithm.members=3", "fsc.check_convergence=on"], {"ORBWEAVE_ALGORITHM_BETA": "0.7"})
    assert (s.members, s.beta, s.check_convergence, s.quarter, s.m, s.m_upsampled, s.reduced_det_shape) == (3, 0.7, True, 40, 161, 322, (4, 16, 16))
    f.write_text(s.as_toml())
    assert load(f, env={}) == s
    for bad in (["members=3"], ["algorithm.members"], ["algorithm.nothing=1"]):
        with pytest.raises(ValueError):
            load(None, bad, {})


@pytest.mark.parametrize("ids", [[3, 10_000, 5, 77, 4096, 4095, 900_000, -(2**40), 2**50], [7] * 500 + [8, -1], [i * 1_000_003 for i in range(3000)], []])
def test_ranks_of_sparse_repeated_and_negative_ids(spark, ids):
    rows = spark.createDataFrame([(i, float(n % 5)) for n, i in enumerate(ids)], "id long, v double").repartition(5)
    out = T.ranked(rows, "id", totals={"so_far": "v"})
    got = sorted(((r["rank"], r["id"], r["v"], r["so_far"]) for r in out.collect()))
    assert [r[:2] for r in got] == list(enumerate(sorted(ids)))
    assert all(abs(r[3] - sum(x[2] for x in got[: r[0] + 1])) < 1e-9 for r in got[::97])
    # no window over all rows: each has partitions
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Exchange" in plan


def test_stream_stops_when_converged(spark, tmp_path):
    images = spark.range(60).select(F.col("id").alias("image_id"), F.array(F.lit(1.0)).alias("data"))
    images.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("image_id long, data array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    n = S.run_stream(spark, source, str(tmp_path / "store"), str(tmp_path / "cp"), 10, lambda k, df: k == 2, cap=50)
    # images that come after are stored all the same
    assert n == 3 and S.finished(spark, str(tmp_path / "store")) == (3, True) and spark.read.parquet(str(tmp_path / "store/images")).count() == 60


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    images = spark.range(60).select(F.col("id").alias("image_id"), F.array(F.lit(1.0)).alias("data"))
    images.repartition(3).write.parquet(str(tmp_path / "in"))
    schema, ran, seen = "image_id long, data array<double>", [], []
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def broken(k, df):
        if k == 2:
            raise RuntimeError("the driver is lost here")
        ran.append(k)

    def whole(k, df):
        ran.append(k)
        seen.append(df.count())

    args = (str(tmp_path / "store"), str(tmp_path / "cp"), 10)
    with pytest.raises(StreamingQueryException):
        S.run_stream(spark, source(), *args, broken)
    assert ran == [0, 1] and S.finished(spark, args[0]) == (2, False)
    assert S.run_stream(spark, source(), *args, whole) == 6 and ran == [0, 1, 2, 3, 4, 5] and seen[-1] == 60
    assert S.run_stream(spark, source(), *args, whole) == 6 and len(ran) == 6


def test_events_past_the_cap_trigger_generations(spark, tmp_path):
    images = spark.range(26).select(F.col("id").alias("image_id"), F.array(F.lit(1.0)).alias("data"))
    images.repartition(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("image_id long, data array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    n = S.run_stream(spark, source, str(tmp_path / "store"), str(tmp_path / "cp"), 5, lambda k, df: seen.append(df.count()), cap=20, generations=9)
    assert n == 9 and max(seen) == 20 and seen[-5:] == [20] * 5
    # the same law as over a table of events
    rows = S.capped(spark.range(26).withColumnRenamed("id", "event_id"), 5, 20, 9).collect()
    assert {r["generation"] for r in rows} == set(range(9)) and max(r["n_seen"] for r in rows) == 20
    assert [S.triggered(x, 5, 20, 9) for x in (4, 5, 19, 20, 22, 26)] == [0, 1, 3, 4, 6, 9] and S.triggered(26, 5, 20) == 4 and S.triggered(26, 5) == 5


def test_splines_pass_through_values_and_follow_cubics():
    from orbweave.operators import kernels as K

    rng = np.random.default_rng(3)
    vol = rng.normal(size=(5, 5, 5))
    assert np.allclose(K.resample(vol, 5), vol) and np.allclose(K.resample(vol, 9)[::2, ::2, ::2], vol) and np.allclose(K.resample(vol, 9, 1)[::2, ::2, ::2], vol)
    x = np.arange(40.0)
    at = np.linspace(12, 27, 31)
    cubic = lambda t: (t - 20) ** 3 / 100 - (t - 20) ** 2 + t
    assert np.allclose(K.interpolation(40, at) @ cubic(x), cubic(at), atol=1e-3)
    assert np.allclose(K.interpolation(7, np.array([-0.1, 6.1])), 0) and np.allclose(K.interpolation(7, np.linspace(0, 6, 13)).sum(1), 1)
    # a blob that moves comes back to the middle as it was
    i, j, k = np.meshgrid(*[np.arange(17.0)] * 3, indexing="ij")
    blob = lambda a: np.exp(-((i - a[0]) ** 2 + (j - a[1]) ** 2 + (k - a[2]) ** 2) / 8)
    back = K.to_center_of_mass(blob((7.3, 8.6, 8.1)))
    assert np.abs(back - blob((8, 8, 8))).max() < 0.01 and (K.to_center_of_mass(np.zeros((3, 3, 3))) == 0).all()


@pytest.mark.parametrize("warm", [True, False])
def test_streamed_reconstruction(spark, tmp_path, warm):
    from orbweave.plans import stream

    synthetic_slices(spark, 30).select("image_id", "data").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("image_id long, data array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = Settings(side=5, n_generations=4, n_orientations=20, n_phase_loops=1, n_er=1, n_hio=1, members=2, solve_steps=5, out=str(tmp_path / "out"))
    last = stream.run(spark, source, T.detector(spark), s, 10, warm_start=warm)
    assert np.isfinite(last.rho).all() and (last.generation == 3 if warm else last.generation == 0)


def test_outputs_and_command_line(spark, tmp_path, capsys):
    from orbweave.__main__ import main, volume

    vol = C.two_blobs()
    R.write_outputs(spark, str(tmp_path), R.State(1, np.fft.fftshift(vol), vol > 0, np.fft.ifftshift(vol)))
    assert np.allclose(volume(spark, str(tmp_path / "rho_1.mrc")), vol, atol=1e-6)
    main(["toml", "algorithm.members=7"])
    assert "members = 7" in capsys.readouterr().out
    main(["evaluate", "--images", str(tmp_path / "rho_1.mrc"), "--reference", str(tmp_path / "rho_1.mrc")])
    assert float(capsys.readouterr().out.split()[1].rstrip(",")) > 0.8


def test_atoms_of_odd_files(spark, tmp_path):
    from orbweave.sources import pdb

    good = "HETATM    1  O   HOH A   1      10.000  20.000  30.000  1.00  0.00           O"
    (tmp_path / "a.pdb").write_text("\n".join([good, good.replace("10.000", "  oops"), "ATOM", "", "REMARK", good.replace("30.000", "31.000")[:54]]))
    rows = sorted(map(tuple, pdb.read_atoms(spark, str(tmp_path)).collect()))
    assert rows == [(10.0, 20.0, 30.0, 8.0), (10.0, 20.0, 31.0, 8.0)]
    one = pdb.density(pdb.parse(spark.createDataFrame([(good,)], "value string")), 7, 1.0, 1.0).collect()
    assert len(one) == 343 and max(one, key=lambda r: r["v"])[:3] == (3, 3, 3) and max(r["v"] for r in one) == 8.0
    assert pdb.density(pdb.parse(spark.createDataFrame([], "value string")), 7, 1.0, 1.0).count() == 0


def test_reduced_images(spark):
    images = spark.createDataFrame([(3, [float(x) for x in range(64)])], "image_id long, data array<double>")
    s = Settings(det_shape=(1, 8, 8), n_clipping=1, n_binning=1)
    assert R.reduced(images, s).first()["data"] == [22.5, 24.5, 38.5, 40.5] and s.reduced_det_shape == (1, 2, 2)
    assert R.reduced(images, Settings()).first()["data"][63] == 63


def brute_model_match(images, volume, quats, det, scale, batch):
    from orbweave.operators import kernels as K

    rows = np.stack([K.nufft2(volume, *(K.matrix_of(q).T @ det)).real for q in quats])
    std = images.std()
    if scale == "global":
        rows = rows * (std / rows.std())
    elif scale == "batch":
        rows = np.concatenate([rows[a : a + batch] * (std / rows[a : a + batch].std()) for a in range(0, len(rows), batch)])
    d = ((images[:, None] - rows[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("scale,held,chunk", [("global", 16 << 20, 4 << 20), ("batch", 0, 64 * 10), ("none", 64, 64 * 7)])
def test_model_match_equals_brute_force(spark, monkeypatch, scale, held, chunk):
    monkeypatch.setattr(M, "HELD_VALUES", held)
    monkeypatch.setattr(M, "CHUNK_VALUES", chunk)
    images = synthetic_slices(spark, 40).select("image_id", "data")
    det, vol, quats = R.positions(T.detector(spark), 1.0), C.two_blobs(5), E.uniform_rotations(33)
    rows = images.orderBy("image_id").collect()
    at, least = brute_model_match(np.array([r["data"] for r in rows]), vol, quats, det, scale, min(8, chunk // 64))
    got = {r["image_id"]: r for r in M.match_model(images, vol, quats, det, scale, 8).collect()}
    assert len(got) == 40
    for i, r in enumerate(rows):
        x = got[r["image_id"]]
        assert np.allclose(x["q"], quats[at[i]]) and np.isclose(x["distance"], least[i]) and x["data"] == r["data"]
    assert M.match_model(images.limit(0), vol, quats, det, scale).count() == 0 and M.match_model(images, vol, quats[:0], det, scale).count() == 0


def test_a_generation_shuffles_no_images(spark, tmp_path):
    synthetic_slices(spark, 40).select("image_id", "data").write.parquet(str(tmp_path / "images"))
    det = R.positions(T.detector(spark), 1.0)
    matched = M.match_model(spark.read.parquet(str(tmp_path / "images")), C.two_blobs(5), E.uniform_rotations(9), det)
    assert "Exchange" not in matched._jdf.queryExecution().executedPlan().toString()
    grids = A.normal_grids(matched.withColumn("member", F.lit(0)), det, 5)
    plan = grids._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and all("image_id" not in x.split("]")[0] for x in plan.split("RepartitionByExpression")[1:])


def test_slabs_of_many_tasks_add_up(spark):
    images = synthetic_slices(spark, 90).withColumn("member", F.col("image_id") % 2)
    det = R.positions(T.detector(spark), 1.0)
    rows = lambda df: {(r["member"], r["part"], r["slab"]): np.array(r["data"]) for r in A.normal_grids(df, det, 3).collect()}
    a, b = rows(images.coalesce(1)), rows(images.repartition(150))
    assert a.keys() == b.keys() and len(a) == 18 and all(np.allclose(a[k], b[k]) for k in a)


def test_density_cap_is_that_of_the_definition(spark):
    from orbweave.operators import kernels as K

    rng = np.random.default_rng(1)
    rho, mask, support = rng.normal(size=(4, 4, 4)), np.ones((4, 4, 4), bool), rng.random((4, 4, 4)) > 0.5
    new, good = K.impose(rho, 0.5, mask, support)
    level = float(np.quantile(new, 0.6))
    want = np.where(good, new, 0)
    want[new > level] = level
    assert np.array_equal(K.error_reduction(rho, 0.5, mask, support, level), want) and (want[~support] == level).any()
    want = np.where(good, new, rho - 0.3 * new)
    want[new > level] += 2 * 0.3 * new[new > level] - level
    assert np.allclose(K.hybrid(0.3, rho, 0.5, mask, support, level), want)
    assert np.array_equal(K.error_reduction(rho, 0.5, mask, support), np.where(good, new, 0))


def test_streams_refuse_sizes_that_do_not_fit(spark, tmp_path):
    for size, cap in ((0, None), (5, 12), (5, 3)):
        with pytest.raises(ValueError):
            S.run_stream(spark, None, str(tmp_path), str(tmp_path), size, lambda k, df: None, cap)
    events = spark.range(7).withColumnRenamed("id", "event_id")
    got = sorted((r["batch"], r["slot"], r["event_id"]) for r in S.pad(events, 3).collect())
    assert got == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 3), (1, 1, 4), (1, 2, 5), (2, 0, 6), (2, 1, 6), (2, 2, 6)]
    assert S.pad(events.limit(0), 3).count() == 0 and S.pad(events.where("event_id < 6"), 3).count() == 6


def test_reference_density_has_its_atoms(spark):
    from orbweave.sources import pdb

    atoms = spark.createDataFrame([(0.0, 0.0, 0.0, 9.0), (4.0, 0.0, 0.0, 9.0), (-4.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, -0.0)], "x double, y double, z double, electrons double")
    rows = pdb.reference_density(atoms.where("electrons > 5"), 17, np.pi).collect()
    top = sorted(rows, key=lambda r: -r["v"])[:2]
    assert len(rows) == 17**3 and {(r["j"], r["k"]) for r in top} == {(8, 8)} and abs(top[0]["i"] - top[1]["i"]) == 4
    with pytest.raises(ValueError):
        pdb.reference_density(atoms, 4, 1.0)
