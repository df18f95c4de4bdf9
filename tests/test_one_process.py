"""Steps over slabs that follow one another in a task share its Python process."""

import os

import numpy as np

from orbweave.operators import slabs as S


def _slabs(spark, n, thick):
    x = np.random.default_rng(3).normal(size=(5, n**3))
    return S.cut(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vol_id long, data array<double>"), n, thick)


def test_a_chain_of_steps_is_one_process(spark):
    stamped = S.mapped(_slabs(spark, 4, 2), lambda x: np.full_like(x, os.getpid()))
    apart = S.voxels(S.mapped(stamped, lambda x: x - os.getpid()), 4, 2, "v")
    assert apart.count() == 5 * 64 and apart.where("v != 0").count() == 0


def test_a_table_may_begin_several_chains(spark):
    x = _slabs(spark, 4, 2)
    a, b = (S.voxels(S.mapped(x, fn), 4, 2, "v").orderBy("vol_id", "i", "j", "k").toPandas()["v"].to_numpy() for fn in (np.abs, np.negative))
    assert np.array_equal(a, np.abs(b)) and (b < 0).any()


def test_conjugate_gradients_start_one_process_a_task(spark, capsys):
    n, thick, seen = 4, 2, []

    def processes(df):
        df.explain()
        return capsys.readouterr().out.count("MapInArrow")

    def apply(p):
        seen.append(processes(p))
        return S.normal_product(p, np.ones((2 * n,) * 3), np.zeros((n,) * 3), 0.5, 2.0, n, thick)

    got = S.voxels(S.conjugate_gradient(apply, _slabs(spark, n, thick), n, thick, 2), n, thick, "v")
    assert seen == [1, 1] and processes(got) == 1
