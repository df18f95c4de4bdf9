"""Tests of sharding."""

import numpy as np
import pytest
from llm_cases import LONG, odd_docs, same_count
from pyspark.sql import functions as F

from orbweave.llm import sharding


@pytest.mark.parametrize("which", ["sf0.001", "hot"])
def test_shards_are_even_and_slots_gapless(spark, which):
    if which == "hot":
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 100)).otherwise(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), (F.col("id") % 150 + 1).cast("int"))).alias("text"))
    else:
        docs = spark.read.parquet(f"/root/testdata/{which}/documents.parquet")
    rows = sharding.shard(docs).select("doc_id", "text", "shard", "slot", sharding.size_of(F.col("text")).alias("size")).toPandas()
    assert sorted(rows.doc_id) == sorted(r[0] for r in docs.select("doc_id").collect())
    by = rows.groupby("shard")["size"].sum()
    longest = rows["size"].max()
    assert len(by) == 16 and (by - by.mean()).abs().max() <= max(0.02 * by.mean(), longest)
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    together = rows.groupby("text").shard.nunique()
    assert (together > 1).sum() == (1 if which == "hot" else 0)  # only a group larger than a shard is spread


def test_shards_of_odd_documents(spark):
    out = sharding.shard(odd_docs(spark), 4)
    same_count(out)
    rows = out.select("shard", "slot", sharding.size_of(sharding.text_or_empty()).alias("size")).toPandas()
    assert rows.shard.between(0, 3).all() and all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    # two texts are larger than a shard's share; the others are a few bytes
    assert rows.groupby("shard")["size"].sum().max() <= rows["size"].max() + 1000
    assert sharding.shard(odd_docs(spark).limit(0)).count() == 0
    assert {r["text"] for r in out.where("doc_id = 7").collect()} == {LONG}


@pytest.mark.parametrize("hot", ["one id", "null ids", "own ids", "two groups"])
def test_a_third_of_all_rows_being_equal(spark, hot):
    """9,000 rows, 3,000 of them equal in text, and in doc_id too: each shard is within 2 % of the mean, and slots have no gap."""
    own = F.when(F.col("id") < 3000, {"one id": F.lit(7).cast("long"), "null ids": F.lit(None).cast("long"), "own ids": F.col("id"), "two groups": F.col("id") % 2}[hot]).otherwise(F.col("id"))
    same = F.repeat(F.lit("copy "), F.when((F.col("id") % 2 == 0) | (F.lit(hot) != "two groups"), 10).otherwise(11))
    text = F.when(F.col("id") < 3000, same).otherwise(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), (F.col("id") % 20 + 1).cast("int")))
    docs = spark.range(9000).select(own.alias("doc_id"), text.alias("text")).repartition(5)
    rows = sharding.shard(docs).select("doc_id", "shard", "slot", sharding.size_of(F.col("text")).alias("size")).toPandas()
    by = rows.groupby("shard")["size"].sum()
    assert len(rows) == 9000 and len(by) == 16 and (by - by.mean()).abs().max() <= 0.02 * by.mean()
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sorted(rows.doc_id.fillna(-1)) == sorted(-1 if r[0] is None else r[0] for r in docs.select("doc_id").collect())


def test_all_rows_equal(spark):
    rows = sharding.shard(spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text")), 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(rows) == 8 and all(abs(r["n"] - 500) <= 10 and r["last"] == r["n"] - 1 for r in rows)


def test_splitters_are_those_of_a_full_sort(spark):
    """Against brute force: sort all keys, and take of each splitter the key at which the bytes below come nearest to its target."""
    rng = np.random.default_rng(8)
    keys, sizes = rng.integers(-(2**63), 2**63 - 1, 500), rng.integers(1, 900, 500)
    rest = spark.createDataFrame([(int(k), int(b)) for k, b in zip(keys, sizes, strict=True)], "key long, bytes long")
    targets = [float(sizes.sum()) * j / 7 for j in range(1, 7)]
    order = np.argsort(keys)
    below = np.concatenate([[0], np.cumsum(sizes[order])])
    for slack in (0.0, 200.0):
        for found, target in zip(sharding._splitters(rest, targets, slack), targets, strict=True):
            got = int(sizes[keys < found].sum())
            assert abs(got - target) <= max(slack, np.abs(below - target).min())
