"""Dense kernels by identities: adjointness, direct sums, round trips, invariants."""

import numpy as np
import pytest

from orbweave.operators import kernels as K
from orbweave.operators import merging as A
from orbweave.plans.catalogue_runs import two_blobs

RNG = np.random.default_rng(3)


def points(n):
    return [RNG.uniform(-np.pi, np.pi, n) for _ in range(3)]


@pytest.mark.parametrize("n", [4, 5])
def test_transforms_are_adjoint(n):
    h, k, l = points(30)
    v, x = RNG.normal(size=30) + 1j * RNG.normal(size=30), RNG.normal(size=(n, n, n))
    left = np.vdot(K.nufft2(x, h, k, l), v)
    right = np.vdot(x, K.nufft1(v, h, k, l, n))
    assert np.isclose(left, right)


def test_type2_on_a_grid_is_the_fft():
    n = 5
    x = RNG.normal(size=(n, n, n))
    f = 2 * np.pi * np.arange(n) / n
    h, k, l = (a.ravel() for a in np.meshgrid(f, f, f, indexing="ij"))
    assert np.allclose(K.nufft2(x, h, k, l).reshape(n, n, n), np.fft.fftn(np.fft.ifftshift(x)))


@pytest.mark.parametrize("n", [12, 15])
def test_gridding_agrees_with_direct_sums(n):
    h, k, l = points(40)
    v, x = RNG.normal(size=40) + 0j, RNG.normal(size=(n, n, n))
    g = K.GriddedNufft(n)
    assert np.abs(g.type1(v, h, k, l) - K.nufft1(v, h, k, l, n)).max() < 1e-8
    assert np.abs(g.type2(x, h, k, l) - K.nufft2(x, h, k, l)).max() < 1e-7 * np.abs(x).sum()


def test_convolution_is_the_normal_matrix():
    n = 5
    h, k, l = points(60)
    x = RNG.normal(size=(n, n, n))
    direct = K.nufft1(K.nufft2(x, h, k, l), h, k, l, n).real
    kernel = K.nufft1(np.ones(60, complex), h, k, l, 2 * n).real
    assert np.allclose(K.convolve(x, A.kernel_transform(kernel), np.ones(x.shape)), direct)


@pytest.mark.parametrize("mode", ["reflect", "constant", "wrap"])
def test_gauss_of_an_impulse(mode):
    x = np.zeros((7, 7, 7))
    x[3, 3, 3] = 1
    w = K.gauss_weights(1.0, 2.0)
    assert np.allclose(K.gauss(x, 1.0, mode, 2.0)[1:6, 1:6, 1:6], w[:, None, None] * w[:, None] * w)


def test_gauss_keeps_a_constant_where_edges_are_mirrored_or_periodic():
    x = np.ones((4, 4, 4))
    assert np.allclose(K.gauss(x, 0.5, "reflect"), 1) and np.allclose(K.gauss(x, 1.0, "wrap", 2.0), 1)


def test_conjugate_gradient_solves_a_dense_system():
    m = RNG.normal(size=(30, 30))
    m = m @ m.T + np.eye(30)
    d = RNG.normal(size=30)
    x, steps = K.conjugate_gradient(lambda v: m @ v, d, np.zeros(30), 200, 1e-12)
    assert np.allclose(x, np.linalg.solve(m, d)) and steps <= 200
    assert K.conjugate_gradient(lambda v: m @ v, np.zeros(30), np.zeros(30), 5)[1] == 0


def test_solver_recovers_a_volume_from_its_samples():
    n = 5
    h, k, l = points(600)
    x = RNG.normal(size=(n, n, n))
    x = (x + x[::-1, ::-1, ::-1]) / 2
    b = K.nufft2(x, h, k, l)
    kernel = K.nufft1(np.ones(600, complex), h, k, l, 2 * n).real
    apply = A.normal_operator(A.kernel_transform(kernel), np.ones(x.shape), A.outside_ball(n, 1.0), 1e-9, 0.0)
    got, _ = K.conjugate_gradient(apply, K.nufft1(b, h, k, l, n).real, np.zeros(x.shape), 300, 1e-10)
    assert np.abs(got - x).max() < 1e-5


def test_error_reduction_never_gets_worse_and_respects_the_support():
    rho = np.fft.ifftshift(two_blobs())
    amplitude, support = np.abs(np.fft.fftn(rho)), rho > 0.05
    mask = np.ones(rho.shape, bool)
    mask[0, 0, 0] = False
    x, last = support * RNG.random(rho.shape), np.inf
    for _ in range(30):
        x = K.error_reduction(x, amplitude, mask, support)
        assert (x[~support] == 0).all() and (x >= 0).all()
        gap = ((np.abs(np.fft.fftn(x)) - amplitude)[mask] ** 2).sum()
        assert gap <= last * (1 + 1e-9)
        last = gap


def test_phase_limits():
    x = RNG.normal(size=(4, 4, 4))
    mask, support = np.ones(x.shape, bool), np.ones(x.shape, bool)
    assert K.error_reduction(x, 0.5, mask, support, most=0.01).max() <= 0.01
    assert np.isfinite(K.hybrid(0.3, x, 0.5, mask, support, most=0.01)).all()
    with pytest.raises(ValueError):
        K.shrink_wrap(x, "median")


def test_recentering_brings_the_mass_to_the_origin():
    rho = np.roll(np.fft.ifftshift(two_blobs()), (2, -1, 3), (0, 1, 2))[None]
    there = K.roll_to_origin(rho, K.center_of_mass(rho))
    assert (np.abs(K.center_of_mass(there)) <= 1).all()


def test_rotation_round_trip_and_identity():
    vol = two_blobs(15)
    assert np.allclose(K.rotate(vol, np.eye(3)), vol)
    m = K.matrix_of(np.array([np.cos(0.3), 0, np.sin(0.3), 0]))
    back = K.rotate(K.rotate(vol, m), m.T)
    assert np.corrcoef(vol.ravel(), back.ravel())[0, 1] > 0.85
    assert np.allclose(K.matrix_of(np.array([0, 0, 0, 1.0])), np.diag([-1, -1, 1]))


def test_gauss_fit_finds_its_parameters_and_fails_softly():
    x = np.arange(50.0)
    got = K.gauss_fit(x, 7 * np.exp(-((x - 20) ** 2) / (2 * 4**2)))
    assert np.allclose(np.abs(got), (7, 20, 4), atol=1e-4)
    assert K.gauss_fit(x, np.zeros(50)) == (0.0, 0.0, 0.0) and K.gauss_fit(x[:2], x[:2]) == (0.0, 0.0, 0.0)


def test_resample_keeps_corners_and_linear_fields():
    i, j, k = np.meshgrid(*[np.arange(4.0)] * 3, indexing="ij")
    got = K.resample(i + 2 * j - k, 7)
    assert got.shape == (7, 7, 7) and np.isclose(got[-1, -1, -1], 6) and np.isclose(got[3, 0, 0], 1.5)
