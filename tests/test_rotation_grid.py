"""Tests of the nested grid of rotations and of matching over it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import quaternion as Q
from orbweave.operators import evaluation as E
from orbweave.operators import matching as M
from orbweave.operators import rotation_grid as G
from orbweave.plans import catalogue_runs as C
from orbweave.plans import reconstruct as R
from orbweave.sources import tables as T


def slices(spark, quats, vol, det, noise=0.0):
    rng = np.random.default_rng(8)
    rows = M._slices(vol, quats, det, 0, len(quats))
    rows = rows + noise * rng.normal(size=rows.shape)
    return rows, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "image_id long, data array<double>")


def test_cells_nest_and_cover(spark):
    table = G.rotation_table(spark, 2)
    got = table.select("cell", "parent", G.cell_of(Q.quat(), 2).alias("own"), G.cell_of(Q.quat(), 1).alias("above"), (F.col("w") ** 2 + F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("size")).collect()
    assert len(got) == 64 and all(r["own"] == r["cell"] and r["above"] == r["parent"] == r["cell"] // 8 and abs(r["size"] - 1) < 1e-12 for r in got)
    quats = E.uniform_rotations(8000)
    counts = np.bincount(G.cells_of(quats, 1), minlength=8)
    assert counts.min() > 900 and (G.cells_of(quats, 4) // 8 == G.cells_of(quats, 3)).all() and (G.cells_of(-quats, 3) == G.cells_of(quats, 3)).all()
    some = spark.createDataFrame([[float(v) for v in q] for q in quats[:200]], "w double, x double, y double, z double")
    assert [r[0] for r in some.select(G.cell_of(Q.quat(), 3)).collect()] == G.cells_of(quats[:200], 3).tolist()


@pytest.mark.parametrize("n,scale,noise", [(1, "none", 0), (30, "global", 0.5), (700, "none", 0.2), (5000, "global", 0)])
def test_nested_match_equals_the_full_search(spark, monkeypatch, n, scale, noise):
    det, vol, quats = R.positions(T.detector(spark), 1.0), C.two_blobs(5), E.uniform_rotations(n)
    _, images = slices(spark, E.uniform_rotations(37)[7:], vol, det, noise)
    want = {r["image_id"]: r for r in M.match_model(images, vol, quats, det, scale).collect()}
    monkeypatch.setattr(M, "HELD_VALUES", 64 * 20 if n == 700 else 16 << 20)
    monkeypatch.setattr(M, "CHUNK_VALUES", 64 * 7 if n == 700 else 4 << 20)
    got = G.match_nested(images, vol, quats, det, scale).collect()
    assert len(got) == len(want) == 30
    for r in got:
        x = want[r["image_id"]]
        assert np.isclose(r["distance"], x["distance"], atol=1e-8) and r["data"] == x["data"] and 0 < r["compared"] <= 2 * n + 100
        assert r["q"] == x["q"]


def test_images_of_the_model_meet_few_slices(spark):
    det, vol, quats = R.positions(T.detector(spark), 1.0) / 2, C.two_blobs(5), E.uniform_rotations(20_000)
    _, images = slices(spark, quats[123::997], vol, det)
    got = G.match_nested(images, vol, quats, det, "none").orderBy("image_id").collect()
    assert [r["q"] for r in got] == [list(q) for q in quats[123::997]]
    assert max(r["compared"] for r in got) < len(quats) / 4


def test_nested_match_of_nothing_and_of_copies(spark):
    det, vol, quats = R.positions(T.detector(spark), 1.0), C.two_blobs(5), E.uniform_rotations(50)
    rows, images = slices(spark, quats[:3], vol, det)
    assert G.match_nested(images.limit(0), vol, quats, det).count() == 0 and G.match_nested(images, vol, quats[:0], det).count() == 0
    twice = np.concatenate((quats, quats, -quats))  # ties: the lower orientation
    got = G.match_nested(images.union(images), vol, twice, det, "none").collect()
    assert len(got) == 6 and all(np.allclose(r["q"], quats[r["image_id"]]) for r in got)
    with pytest.raises(ValueError):
        G.match_nested(images, vol, quats, det, "batch")
