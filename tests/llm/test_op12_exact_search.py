"""Tests of exact top-k search."""

import math

import numpy as np
import pytest

from orbweave.llm import exact_search as es

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, score string, rank int"


def brute(rows, k=20, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {(i, tuple(v)) for i, v in good if i is not None and i % every == 0}:
        found = [(-sum(a * b for a, b in zip(q, v, strict=True)), (j is None, j), j) for j, v in good if j != i and len(v) == len(q)]
        out += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(sorted(found, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in df.collect()), key=repr)


def table_of(spark, rows, parts=1):
    return spark.createDataFrame([(i, v, 1, "s", "x", 1) for i, v in rows], SCHEMA).repartition(parts)


def random_rows(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, dim)).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[0]  # a third of all rows is one vector
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_odd_vectors(spark):
    rows = [
        (0, [0.5, -0.25]), (20, [0.1, 0.2]), (20, [0.1, 0.2]), (40, [0.3, 0.3]), (40, [-0.3, 0.3]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]),
        (None, [0.5, 0.5]), (3, None), (60, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (80, [float("inf"), 0.0]), (6, [1.0]), (100, [1.0]), (120, []),
        (7, []), (-20, [0.25, 0.5]), (140, [1.0, 2.0, 3.0]),
    ]
    assert got(es.top_k(table_of(spark, rows))) == brute(rows)
    assert got(es.top_k(table_of(spark, rows, 5), k=2)) == brute(rows, 2)
    assert es.top_k(table_of(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows,leaf", [(16384, 256), (64, 8), (50, 1000)])
def test_equals_brute_force_over_any_shards(spark, monkeypatch, shard_rows, leaf):
    monkeypatch.setattr(es, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(es, "LEAF", leaf)
    rows = random_rows(700)
    assert got(es.top_k(table_of(spark, rows, 3))) == brute(rows)


def test_a_box_bounds_and_prunes():
    rng = np.random.default_rng(2)
    # groups far apart: whole branches can't hold what is best
    points = np.concatenate([rng.integers(-5, 5, (500, 6)) + 60 * np.eye(6, dtype=np.int64)[i % 6] for i in range(8)])
    tree = es.Tree(np.arange(len(points)), points)
    q = points[rng.choice(len(points), 50, replace=False)]
    for depth in range(tree.depth + 1):
        bound = tree.bounds(q, depth)
        for n, (a, b) in enumerate(tree.edges[depth]):
            assert (es.dots(q, tree.points[a:b]).max(1) <= bound[:, n]).all()
            assert (tree.points[a:b].min(0) == tree.lo[2**depth - 1 + n]).all()
    asked = []
    plain = es.dots
    try:
        es.dots = lambda a, b: asked.append(len(a) * len(b)) or plain(a, b)
        best = es.Best.none(len(q), 5)
        es.search(tree, np.full(len(q), -1), q, best)
    finally:
        es.dots = plain
    truth = plain(q, tree.points)
    for r in range(len(q)):
        order = np.lexsort((tree.ids, -truth[r]))[:5]
        assert best.ids[r].tolist() == tree.ids[order].tolist()
    assert sum(asked) < 0.8 * truth.size


def test_scores_beyond_doubles_and_longs():
    a = np.array([[2**31 - 1, 1]])
    assert es.dots(a, a).tolist() == [[(2**31 - 1) ** 2 + 1]]
    wide = np.full((1, 4), 2**31 - 1)
    assert es.dots(wide, wide).tolist() == [[2**63 - 1]] and es.dots(wide, -wide).tolist() == [[-(2**63) + 2]]


def test_equal_vectors_are_pruned_by_their_ids():
    points = np.ones((4096, 4), dtype=np.int64)
    tree = es.Tree(np.random.default_rng(0).permutation(4096), points)
    best = es.Best.none(1, 20)
    es.search(tree, np.array([-1]), points[:1], best)
    assert best.ids[0].tolist() == list(range(20))
    before = es.dots
    seen = []
    try:
        es.dots = lambda a, b: seen.append(len(b)) or before(a, b)
        es.search(tree, np.array([-1]), points[:1], best)
    finally:
        es.dots = before
    assert seen.count(256) == 1  # of all leaves only the one with smaller ids than the 20th is open
