"""Tests of ranked lexical search."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import DOCS, odd_docs

from orbweave.llm import ranked_search as rs

ITEMS = "item_id long, text string, score string, rank int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    found = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(1 for c in found if c), sum(c.total() for c in found)
    df = Counter(t for c in found for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scores = []
        for (doc_id, _), c in zip(docs, found, strict=True):
            m = 10 + 90 * c.total() * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, (doc_id is not None, doc_id), doc_id))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


def test_odd_documents_and_items(spark):
    docs = odd_docs(spark)
    asked = [(1, "SAME text, id W5"), (1, "one"), (2, None), (3, ""), (4, "nowhere"), (5, "same"), (5, "same"), (None, "w1 w2 É x"), (6, "w1 " * 5000)]
    items = spark.createDataFrame([(*x, "s", 1) for x in asked], ITEMS)
    assert got(rs.ranked_search(docs, items)) == brute([(r.doc_id, r.text) for r in docs.collect()], asked)
    assert rs.ranked_search(docs.limit(0), items).count() == 0
    assert rs.ranked_search(docs, items.limit(0)).count() == 0
    assert rs.ranked_search(docs, items.where("item_id in (2, 3)")).count() == 0


@pytest.mark.parametrize("how", ["one shard", "many shards", "many groups", "joined terms"])
def test_equals_brute_force_however_it_is_cut(spark, data, monkeypatch, how):
    monkeypatch.setattr(rs, "SLICE", 16)
    if how == "many shards":
        monkeypatch.setattr(rs, "SHARD_DOCS", 16)
    if how == "many groups":
        monkeypatch.setattr(rs, "QUERIES", 3)
    if how == "joined terms":
        monkeypatch.setattr(rs, "BROADCAST_TERMS", 2)
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(rs.ranked_search(docs, items)) == want


def test_blocks_are_the_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lists = [rng.integers(0, 100, n) for n in rng.integers(0, 9, 5)]
        for x, cuts in zip(lists, rs.cut_blocks(lists, price=60, most=4), strict=True):
            def cost(lengths, x=x):
                at = np.cumsum([0, *lengths])
                return sum(60 + (x[a:b].max() - x[a:b]).sum() for a, b in itertools.pairwise(at))

            every = [c for r in range(len(x) + 1) for c in itertools.product(range(1, 5), repeat=r) if sum(c) == len(x)]
            assert cuts.sum() == len(x) and cost(cuts) == min(map(cost, every))


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(9)
    n = 6000
    lengths = rng.integers(20, 400, n).astype("<i4")
    lists, truth = [], np.zeros(n, dtype=np.int64)
    for w in (3000, 900, 400, 50, 10):
        docs = np.sort(rng.choice(n, 2000, replace=False))
        tf = np.ones(len(docs), dtype=np.int64)
        tf[docs // 100 == w % 60] = 9  # few stretches of high impacts
        x = rs.impacts(tf, lengths[docs], n, int(lengths.sum()))
        cuts = np.concatenate(rs.cut_blocks([x[a : a + rs.STRETCH] for a in range(0, len(x), rs.STRETCH)], price=200_000))
        lists.append((w, docs, tf, cuts, np.maximum.reduceat(x, np.cumsum(cuts) - cuts)))
        truth[docs] += w * x
    read = []
    number, score = rs.search_shard(lists, lengths, n, int(lengths.sum()), 10, np.arange(n), read)
    order = np.lexsort((np.arange(n), -truth))[:10]
    assert number.tolist() == order.tolist() and score.tolist() == truth[order].tolist()
    assert sum(scored for _, scored in read) < 0.2 * n
    assert sum(blocks for blocks, _ in read) < sum(len(x[3]) for x in lists)


def test_clashing_columns_are_ignored(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1, 3, "k", "h", "r", "x", "y", 1)], DOCS).withColumnsRenamed({"shard": "term", "key": "query"})
    items = spark.createDataFrame([(7, "a", "s", 1)], ITEMS)
    assert got(rs.ranked_search(docs, items)) == brute([(1, "a b")], [(7, "a")])
