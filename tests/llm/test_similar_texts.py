"""Tests of similar texts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import brute_similar, odd_docs, pairs, same_count

from orbweave.llm import similar_texts


def families_of_copies():
    """A base and copies with a few words changed, chains of such changes, and strangers; docs in order of doc_id."""
    rng = random.Random(9)
    line = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    docs = [" ".join(line(rng.randint(1, 80))) for _ in range(80)]
    for n in (3, 12, 40):
        base = line(200)
        docs.append(" ".join(base))
        for _ in range(n):
            w = list(base)
            for at in rng.sample(range(200), 3):
                w[at] = "changed%d" % rng.randint(0, 99)
            docs.append(" ".join(w).upper() if n == 3 else " ".join(w))
        for _ in range(6):
            w[rng.randrange(200)] = "chain"
            docs.append("  ".join(w))
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("closed,orders", [(2 << 20, 4), (100, 4), (100, 0), (3000, 0)])
def test_similar_groups_equal_brute_force(spark, monkeypatch, closed, orders):
    monkeypatch.setattr(similar_texts, "CLOSED", closed)  # the small bounds close families by runs, by rare shingles and by pairs of blocks
    monkeypatch.setattr(similar_texts, "ORDERS", orders)
    docs = families_of_copies()
    got = dict(pairs(similar_texts.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "component_id"))
    assert got == brute_similar(docs)


def sets_by_groups(groups, rng):
    """Sets of 21 around a core of 20 each, alike within a group (20 of 22); half of each core is that of all others."""
    common = list(range(10))
    for g in range(groups):
        core = [1000 + 10 * g + i for i in range(10)] + common
        for m in range(rng.randint(1, 4)):
            yield g, [*core, 1_000_000 + 4 * g + m]


@pytest.mark.parametrize("orders", [0, 4])
def test_component_of_twenty_thousand_texts_is_closed_in_a_fixed_number_of_steps(spark, monkeypatch, orders):
    steps = []
    named = similar_texts.materialise
    monkeypatch.setattr(similar_texts, "materialise", lambda df, what: steps.append(what) or named(df, what))
    monkeypatch.setattr(similar_texts, "CLOSED", 40_000)
    monkeypatch.setattr(similar_texts, "ORDERS", orders)
    taken = {}
    for groups in (800, 8000):
        steps.clear()
        rows = [(7, node, shingles, g) for node, (g, shingles) in enumerate(sets_by_groups(groups, random.Random(3)))]
        members = similar_texts.materialise(spark.createDataFrame([r[:3] for r in rows], "component long, node long, shingles array<long>"), "members")
        roots = similar_texts.connected_components(similar_texts._close_large(members, similar_texts._sizes(members)))
        got = dict(pairs(roots, "node", "root"))
        first = {}
        for _, node, _, g in rows:
            first.setdefault(g, node)
        assert all(got.get(node, node) == first[g] for _, node, _, g in rows)
        taken[groups] = list(steps)
    assert len(rows) > 19_000 and taken[800] == taken[8000]


def test_runs_of_a_component_are_bounded(monkeypatch):
    seen = []
    monkeypatch.setattr(similar_texts, "_close", lambda nodes, sets: seen.append(sum(map(len, sets))) or [])
    batch = pa.record_batch([pa.array([1] * 50 + [2] * 3), pa.array(range(53)), pa.array([[1, 2, 3]] * 53, pa.list_(pa.int64()))], names=["component", "node", "shingles"])
    list(similar_texts._close_components(iter([batch]), most=30))
    assert seen == [30] * 5 + [9]
    seen.clear()
    list(similar_texts._close_components(iter([batch])))
    assert seen == [150, 9]


def test_recall_of_similar_groups_on_driver_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    want = brute_similar(docs)
    got = dict(pairs(similar_texts.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "component_id"))
    gone = {d for d, c in want.items() if d != c}
    found = {d for d, c in got.items() if d != c}
    assert found <= gone and len(found) >= 0.95 * len(gone)


def edited_passages(n=120):
    """Pairs at a shingle similarity from 0.8 on, and some just below: the tail cut, a foreign tail, one passage replaced."""
    rng = random.Random(4)
    line = lambda n: [f"v{rng.randint(0, 20_000)}" for _ in range(n)]
    docs, kinds = [], []
    for i in range(3 * n):
        w = line(rng.randint(60, 900))
        share, kind = rng.uniform(0.78, 0.84), ("cut", "appended", "replaced")[i % 3]
        if kind == "cut":
            x = w[: round(share * len(w)) + 1]
        elif kind == "appended":
            x = w + line(round(len(w) * (1 / share - 1)))
        else:
            gone = round(len(w) * (1 - share) / (1 + share)) - 4
            at = rng.randint(0, len(w) - max(gone, 1))
            x = w[:at] + line(max(gone, 1)) + w[at + max(gone, 1) :]
        docs += [" ".join(w), " ".join(x)]
        kinds += [kind, kind]
    return list(enumerate(docs)), kinds


def test_cut_added_and_replaced_passages_are_found(spark):
    docs, kinds = edited_passages()
    want = brute_similar(docs)
    got = dict(pairs(similar_texts.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "component_id"))
    count = lambda x: Counter(kinds[d] for d, c in x.items() if d != c)
    assert min(count(want).values()) > 60 and len(count(want)) == 3
    assert count(got) == count(want) and got == want


def test_bands_agree_as_often_as_shingles_do():
    rng = np.random.default_rng(2)
    hits = []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 500).astype(np.uint64)
        a, b = similar_texts.band_keys(np.concatenate((x[:450], x[50:])), np.repeat([0, 1], 450), 2)  # 400 of 500
        hits.append(np.mean(np.array(a) == np.array(b)))
    assert abs(np.mean(hits) - 0.8**similar_texts.ROWS) < 0.03 and min(hits) > 0
    assert (1 - 0.8**similar_texts.ROWS) ** similar_texts.BANDS < 1e-8
    assert similar_texts.band_keys(np.zeros(0, np.uint64), np.zeros(0, int), 2) == [[], []]


def test_similar_groups_of_odd_documents(spark):
    out = similar_texts.near_duplicates(odd_docs(spark))
    same_count(out)
    got = pairs(out, "doc_id", "component_id")
    assert {c for d, c in got if d in (1, 2, 3)} == {1} and {c for d, c in got if d in (5, 6)} == {5}
    assert similar_texts.near_duplicates(odd_docs(spark).limit(0)).count() == 0
