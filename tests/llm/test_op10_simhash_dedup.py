"""Tests of near duplicates."""

import random
import re

import numpy as np
import pytest
import xxhash
from llm_cases import odd_docs, pairs, same_count

from pyspark.sql import functions as F

from orbweave.llm import components, simhash_dedup
from orbweave.llm.queries import QUERIES


def brute_components(fps, radius=3):
    n = len(fps)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array(fps, dtype=np.uint64)
    for i in range(n):
        for j in np.nonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= radius)[0] + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_near_duplicates_equal_brute_force(spark, data, duck):
    rows = duck.execute("select doc_id, text from documents order by doc_id").fetchall()
    fps = [brute_print(t) for _, t in rows]
    root = brute_components(fps)
    want = [(d, f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, root, strict=True)]
    assert pairs(QUERIES["op10_simhash_dedup"](spark, data), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


@pytest.mark.parametrize("leaf,split,parts", [(1500, 4096, None), (20, 64, None), (20, 64, 4), (20, 64, 5), (20, 4096, 6)])
def test_trees_find_every_link(spark, monkeypatch, leaf, split, parts):
    """Chains, dense balls and strangers, through deep trees, trees over parts, and leaves that split."""
    if parts:
        monkeypatch.setattr(simhash_dedup, "_parts", lambda n, radius: parts)
    monkeypatch.setattr(simhash_dedup, "LEAF", leaf)
    monkeypatch.setattr(simhash_dedup, "SPLIT", split)
    monkeypatch.setattr(simhash_dedup, "PARTS_FROM", 0 if parts else 4_000_000)
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(1500)]
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(2, 12)):
            fps.append(x)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
    ball = rng.getrandbits(64)
    fps += [ball ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps = sorted(set(fps))
    root = brute_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash_dedup.link(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert edges.count() < (20 if parts else 4) * len(fps)
    at = {f: i for i, f in enumerate(signed)}
    label = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    groups = lambda ids: sorted(sorted(g) for g in ids.values() if len(g) > 1)
    want, got = {}, {}
    for i, r in enumerate(root):
        want.setdefault(r, []).append(i)
    for f, r in label.items():
        got.setdefault(r, []).append(at[f])
    assert groups(got) == groups(want)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(pairs(components.connected_components(edges), "node", "root"))
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500
    assert components.connected_components(edges.limit(0)).count() == 0


def test_near_duplicates_of_odd_documents(spark):
    out = simhash_dedup.near_duplicates(odd_docs(spark))
    same_count(out)
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in out.collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == got[None, 0] == 1 and {v for (d, _), v in got.items() if d in (5, 6)} == {5}
    assert simhash_dedup.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_trees_over_parts_grow_with_the_fingerprints():
    assert [simhash_dedup._parts(n, 3) for n in (4e6, 1e9, 1e11)] == [4, 5, 6]
    for n in (1e3, 1e7, 1e9, 1e12):
        trees, search = simhash_dedup._trees(n, 3)
        rng = random.Random(1)
        for _ in range(200):
            apart = sum(1 << b for b in rng.sample(range(64), 3))
            assert min((apart & t).bit_count() for t in trees) <= search


def test_hot_fingerprints_are_dealt_into_parts(spark, monkeypatch):
    from orbweave.llm import common

    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    names = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    want = pairs(rows.join(names.drop("n"), "k"), "k", "id", "first")
    for heavy in (1000, 10, 1):
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert pairs(common.join_counted(rows, names, ["k"], 1000), "k", "id", "first") == want
        assert pairs(common.join_spread(rows, names.drop("n"), ["k"]), "k", "id", "first") == want
