"""Tests of quality classifier."""

import zlib
from collections import Counter

import numpy as np
from llm_cases import odd_docs, same_count

from pyspark.sql import functions as F

from orbweave.llm import quality_classifier
from orbweave.llm.queries import QUERIES


def test_held_out_accuracy(spark, data, duck):
    got = {r["doc_id"]: r for r in QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    out = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert len(got) == 1000 and np.mean([p == q for p, q in out]) > 0.95
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_dual_coordinate_descent_meets_the_optimum():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for i in range(120):
        k = i % 2
        rows.append(np.unique(np.concatenate(([0], rng.integers(1, 40, 6) + 40 * k, rng.integers(100, 140, 4)))).astype(np.int32))
        y.append(1.0 if k else -1.0)
    y = np.array(y)
    model = quality_classifier.fit(rows, y)
    w, ratio = np.split(model.astype(float), 2)
    margins = np.array([w[f] @ (ratio[f] / np.sqrt((ratio[f] ** 2).sum())) for f in rows])
    assert ((margins > 0) == (y > 0)).mean() > 0.97

    def loss(w):
        m = np.array([w[f] @ (ratio[f] / np.sqrt((ratio[f] ** 2).sum())) for f in rows])
        return 0.5 * (w @ w) + quality_classifier.COST * np.maximum(0, 1 - y * m).sum()

    best = loss(w)
    for _ in range(50):
        near = w + rng.normal(scale=0.02, size=len(w)) * (ratio != 0)
        assert loss(near) > best * 0.999


def test_classifier_edge_cases(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (4, None, 0), (None, 1, 1), (3, 1, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    same_count(quality_classifier.classify(docs, labels, docs.columns).drop("score"))
    none = quality_classifier.classify(docs, labels.limit(0), ["doc_id", "text"]).collect()
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in none)
    assert quality_classifier.classify(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_labels_without_documents_do_not_use_up_the_sample(spark, data, monkeypatch):
    monkeypatch.setattr(quality_classifier, "FIT_ROWS", 60)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    stray = spark.range(1_000_000, 1_003_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    want = quality_classifier.train(docs, labels)
    assert want.any() and (quality_classifier.train(docs, labels.union(stray)) == want).all()
    long_texts = stray.select("doc_id", F.lit("x" * (quality_classifier.FIT_BYTES + 1)).alias("text")).limit(100)
    both = docs.select("doc_id", "text").union(long_texts)
    assert (quality_classifier.train(both, labels.union(stray)) == want).all()


def test_scores_equal_a_plain_fit(spark):
    """The whole result against dictionaries of features and a subgradient-free reference: the same weights give the same scores."""
    good = [f"eine gute zeile nummer {i} mit vielen worten und satz {i * 7}" for i in range(30)]
    bad = [f"CLICK!! ### win {i} $$$ free free free {i * 3}" for i in range(30)]
    rows = [(i, t, k) for i, (t, k) in enumerate([(t, 1) for t in good] + [(t, 0) for t in bad])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_classifier.train(docs, docs.select("doc_id", "quality"))
    w, ratio = np.split(model.astype(float), 2)
    make = quality_classifier.Features()
    used = [(i, t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    # log-count ratios from plain counts
    p, q = Counter(), Counter()
    for _, t, k in used:
        (p if k else q).update(next(make.of([t])).tolist())
    total = lambda c: sum(c.values()) + quality_classifier.BUCKETS * quality_classifier.SMOOTH
    for f in list(p | q)[:500]:
        if f != quality_classifier.BIAS:
            want = np.log((p[f] + 1) / total(p)) - np.log((q[f] + 1) / total(q))
            assert abs(ratio[f] - want) < 1e-5
    # scores from the definition, over sets of features
    got = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, docs.select("doc_id", "quality"), ["doc_id"]).collect()}
    for i, t, k in rows:
        f = sorted(set(next(make.of([t])).tolist()))
        x = ratio[f] / np.sqrt((ratio[f] ** 2).sum())
        assert abs(got[i] - 1 / (1 + np.exp(-quality_classifier.STEEP * float(w[f] @ x)))) < 1e-9 and (got[i] >= 0.5) == (k == 1)
