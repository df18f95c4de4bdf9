"""Operators over slabs against the same on whole volumes."""

import numpy as np
import pytest

from orbweave.operators import kernels as K
from orbweave.operators import merging as A
from orbweave.operators import slabs as S


def stack(count, n, seed=0):
    return np.random.default_rng(seed).normal(0, 1, (count, n, n, n))


def tables(spark, x):
    return spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "vol_id long, data array<double>").repartition(3)


def back(slabs, n, thick, pencils=False, complex_=False):
    names = ["re", "im"] if complex_ else ["v"]
    t = S.voxels(slabs, n, thick, *names, pencils=pencils, complex_=complex_).toPandas()
    out = np.full((t.vol_id.max() + 1, n, n, n), np.nan, dtype=complex if complex_ else float)
    out[t.vol_id, t.i, t.j, t.k] = t.re + 1j * t.im if complex_ else t.v
    assert len(t) == out.size and not np.isnan(out).any()
    return out


@pytest.mark.parametrize("n,thick", [(6, 1), (6, 2), (6, 6), (5, 1)])
def test_transform_has_one_exchange_and_equals_the_whole(spark, n, thick, monkeypatch):
    monkeypatch.setattr(S, "TAKE", 3000)  # groups run over batches
    x = stack(5, n)
    f = S.forward(S.cut(tables(spark, x), n, thick), n, thick)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert np.allclose(back(f, n, thick, True, True), np.fft.fftn(x, axes=(1, 2, 3)))
    again = S.backward(S.forward(S.cut(tables(spark, x), n, thick), n, thick, back=True), n, thick)
    assert np.allclose(back(again, n, thick), x)


def test_a_task_holds_tiles_not_volumes(spark):
    """What is exchanged and held for a group grows with the square of the side: a slab, or a pencil."""
    for n, thick in ((8, 1), (16, 1), (16, 2)):
        rows = S._exchange(S.forward(S.cut(tables(spark, stack(1, n)), n, thick), n, thick, back=True), [], n // thick).selectExpr("block", "octet_length(data) as size").toPandas()
        assert (rows["size"] == 16 * thick * thick * n).all() and (rows.groupby("block")["size"].sum() == 16 * thick * n * n).all()


@pytest.mark.parametrize("mode,sigma,truncate", [("wrap", 1.0, 2.0), ("reflect", 0.5, 4.0), ("constant", 1.0, 2.0), ("constant", 0.5, 2.0)])
@pytest.mark.parametrize("n,thick", [(6, 1), (6, 3), (4, 2), (2, 1)])
def test_stencils_by_halo_exchange(spark, mode, sigma, truncate, n, thick):
    x = stack(3, n)
    if int(truncate * sigma + 0.5) > n:
        return
    assert np.allclose(back(S.gauss(S.cut(tables(spark, x), n, thick), n, thick, sigma, mode, truncate), n, thick), K.gauss(x, sigma, mode, truncate))


def test_convolution_and_regulariser(spark):
    n, thick = 6, 2
    x, kf = stack(3, n), np.fft.fftn(stack(1, 12, 3)[0])
    slabs = S.cut(tables(spark, x), n, thick)
    assert np.allclose(back(S.convolve(slabs, kf, n, thick), n, thick), K.convolve(x, kf, np.ones(x.shape)))
    outside = A.outside_ball(n, 1.0)
    assert np.allclose(back(S.fourier_reg(slabs, outside, n, thick), n, thick), K.fourier_reg(x, np.ones(x.shape), outside))
    # the kernel as a table of pencils: real parts, then imaginary ones
    rows = []
    for vol in range(3):
        for b in range(12 // thick):
            own = kf[:, b * thick : (b + 1) * thick]
            rows.append((vol, b, 0, np.stack([own.real, own.imag]).tobytes()))
    table = spark.createDataFrame(rows, S.ROWS)
    assert np.allclose(back(S.convolve(slabs, table, n, thick), n, thick), K.convolve(x, kf, np.ones(x.shape)))


@pytest.mark.parametrize("beta,most", [(None, np.inf), (0.3, np.inf), (None, 0.2), (0.3, 0.2)])
def test_steps_with_support_and_measured_amplitudes(spark, beta, most):
    n, thick = 6, 3
    x, measured = stack(4, n), np.abs(np.fft.fftn(stack(4, n, 7), axes=(1, 2, 3)))
    inside = stack(4, n, 9) > -0.5
    mask = np.ones((n, n, n), dtype=bool)
    mask[0, 0, 0] = False
    pencils = spark.createDataFrame([(v, b, 0, measured[v][:, b * thick : (b + 1) * thick].tobytes()) for v in range(4) for b in range(n // thick)], S.ROWS)
    got = S.step(S.cut(tables(spark, x), n, thick), n, thick, pencils, S.cut(tables(spark, inside.astype(float)), n, thick), beta, most)
    want = K.error_reduction(x, measured, mask, inside, most) if beta is None else K.hybrid(beta, x, measured, mask, inside, most)
    assert np.allclose(back(got, n, thick), want)


@pytest.mark.parametrize("method", ["std", "max"])
def test_shrink_wrap_takes_its_level_from_all_slabs(spark, method):
    x = stack(3, 6)
    got = back(S.shrink_wrap(S.cut(tables(spark, x), 6, 2), 6, 2, method, 1.1, 0.3), 6, 2)
    assert np.array_equal(got > 0, K.shrink_wrap(x, method, 1.1, 0.3))


def test_retrieval_equals_that_of_whole_volumes(spark):
    n, thick = 8, 2
    rho = np.zeros((2, n, n, n))
    rho[:, 3:5, 3:6, 3:5] = np.random.default_rng(1).random((2, 2, 3, 2))
    ac = np.fft.fftshift(K.autocorrelation(rho), axes=(1, 2, 3))
    first = np.random.default_rng(2).random((2, n, n, n))
    got, support = S.retrieve(S.cut(tables(spark, ac), n, thick), n, thick, S.cut(tables(spark, first), n, thick), 2, 2, 1, 0.3)
    for v in range(2):
        smooth = np.fft.ifftshift(K.gauss(np.maximum(ac[v], 0), 1.0, "constant", 2.0))
        amplitude, mask = np.sqrt(np.abs(np.fft.fftn(smooth))), np.ones((n, n, n), dtype=bool)
        mask[0, 0, 0] = False
        inside = K.box_support(smooth, n // 4)
        x = first[v] * inside
        for _ in range(2):
            for b in (None, None, 0.3, None, None):
                x = K.error_reduction(x, amplitude, mask, inside) if b is None else K.hybrid(b, x, amplitude, mask, inside)
            inside = K.shrink_wrap(x)
        for _ in range(2):
            x = K.error_reduction(x, amplitude, mask, inside)
        assert np.allclose(back(got, n, thick)[v], x, atol=1e-9) and np.array_equal(back(support, n, thick)[v] > 0, inside)


def test_conjugate_gradients_over_slabs(spark):
    n, thick = 4, 2
    kf = A.kernel_transform(K.nufft1(np.ones(8, dtype=complex), *[np.arange(1, 9) * p for p in (0.1, 0.2, -0.15)], 2 * n).real)
    outside, d = A.outside_ball(n, 1.0), stack(5, n)
    apply = A.normal_operator(kf, np.ones((n, n, n)), outside, 0.5, 2.0)
    got = S.conjugate_gradient(lambda p: S.normal_product(p, kf, outside, 0.5, 2.0, n, thick), S.cut(tables(spark, d), n, thick), n, thick, 4)
    want = np.stack([K.conjugate_gradient(apply, x, np.zeros(x.shape), 4, 0.0)[0] for x in d])
    assert np.allclose(back(got, n, thick), want, atol=1e-8)
