"""Gridding over slabs against direct sums, and merging over slabs against whole grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_slabs import back

from orbweave.operators import kernels as K
from orbweave.operators import merging as A
from orbweave.operators import slabs as S
from orbweave.operators import tiles as W


def some(spark, count, seed=0, crowd=0.3):
    """Points of two volumes; most lie close together, and a third is one point."""
    rng = np.random.default_rng(seed)
    p = np.clip(rng.normal(0, crowd, (count, 3)), -3.1, 3.1)
    p[: count // 3] = p[0]
    v = rng.normal(0, 1, count)
    rows = [(i % 2, *map(float, p[i]), float(v[i])) for i in range(count)]
    return p, v, spark.createDataFrame(rows, "vol_id long, h double, k double, l double, v double").repartition(3)


@pytest.mark.parametrize("n,grid_thick,thick", [(6, 3, 2), (8, 4, 8), (15, 5, 3)])
def test_tiled_gridding_equals_direct_sums(spark, n, grid_thick, thick):
    p, v, points = some(spark, 120)
    got = back(W.type1(points, n, grid_thick, thick), n, thick)
    for vol in range(2):
        own = np.arange(120) % 2 == vol
        want = K.nufft1(v[own].astype(complex), *p[own].T, n).real
        assert np.abs(got[vol] - want).max() < 1e-8 * np.abs(v).sum()


def test_a_task_holds_a_slab(spark):
    """What a task takes and makes is a slab of the grid: its size doesn't grow with the points, and with the square of the side."""
    for n, count in ((8, 30), (8, 300), (16, 30)):
        _, _, points = some(spark, count)
        rows = W.spread(points, n, 4).selectExpr("octet_length(data) as size", "block").toPandas()
        assert (rows["size"] == 8 * 4 * (2 * n) ** 2).all() and len(rows) == 2 * (2 * n // 4)


def test_merging_over_slabs_equals_that_of_whole_grids(spark):
    n, thick = 6, 3
    rng = np.random.default_rng(3)
    det = np.stack([*(x.ravel() for x in np.meshgrid(*[np.linspace(-2, 2, 4)] * 2)), np.zeros(16)])
    q = rng.normal(0, 1, (9, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    rows = [(0, q[i].tolist(), rng.random(16).tolist()) for i in range(9)]
    images = spark.createDataFrame(rows, "member int, q array<double>, data array<double>").repartition(3)
    rhs, kernel = W.normal_equations(images, det, n, thick)
    whole = {r["part"]: {} for r in A.normal_grids(images, det, n).select("part").distinct().collect()}
    for r in A.normal_grids(images, det, n).collect():
        whole[r["part"]][r["slab"]] = r["data"]
    cube = lambda part, m: np.array([whole[part][i] for i in range(m)]).reshape(m, m, m)
    assert np.allclose(back(rhs, n, thick)[0], cube("rhs", n), atol=1e-6)
    kf = A.kernel_transform(cube("kernel", 2 * n))
    x = rng.normal(0, 1, (1, n, n, n))
    slabs = S.cut(spark.createDataFrame([(0, x.ravel().tolist())], "vol_id long, data array<double>"), n, thick)
    assert np.allclose(back(S.convolve(slabs, kernel, n, thick), n, thick), K.convolve(x, kf, np.ones(x.shape)), atol=1e-5)
    got = back(W.solve(images, det, n, thick, 2.0, 3.0, 5), n, thick)[0]
    apply = A.normal_operator(kf, np.ones((n, n, n)), A.outside_ball(n, 1.0), 2.0, 3.0)
    want, _ = K.conjugate_gradient(apply, cube("rhs", n), np.zeros((n, n, n)), 5, 0.0)
    assert np.allclose(got, want, atol=1e-6)
    assert images.agg(F.count("*")).first()[0] == 9
