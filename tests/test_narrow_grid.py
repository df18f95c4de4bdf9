"""Spreading on a grid that is no wider than the Gaussian."""

import numpy as np

from orbweave.operators import kernels, slabs, tiles


def test_points_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(tiles, "OPEN", 2)
    n, rng = 6, np.random.default_rng(3)
    rows = [(int(vol), *map(float, rng.uniform(-3, 3, 3)), float(rng.normal())) for vol in rng.integers(0, 5, 200)]
    points = spark.createDataFrame(rows, "vol_id long, h double, k double, l double, v double")
    got = tiles.type1(points, n, 3, 2)
    spread = tiles.spread(points, n, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert spread.count("RepartitionByExpression") == 1 and "Generate explode" not in spread
    cubes = {}
    for r in slabs.voxels(got, n, 2, "v").collect():
        cubes.setdefault(r["vol_id"], np.zeros((n, n, n)))[r["i"], r["j"], r["k"]] = r["v"]
    assert sorted(cubes) == sorted({r[0] for r in rows})
    for vol, cube in cubes.items():
        own = np.array([r[1:] for r in rows if r[0] == vol])
        assert np.allclose(cube, kernels.nufft1(own[:, 3].astype(complex), *own[:, :3].T, n).real, atol=1e-6)
