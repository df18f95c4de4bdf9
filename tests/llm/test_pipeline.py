"""Tests of the pipeline."""

import pytest
from llm_cases import check_packing, odd_docs, pairs
from pyspark.sql import functions as F

from orbweave.llm import common, personal_data, stages


def test_pipeline_stages(spark):
    import corpus_pipeline
    from orbweave.llm.common import materialise

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, d), name)
        steps[name] = docs
        assert name == "pack" or docs.columns == columns
    n = {k: v.count() for k, v in steps.items()}
    assert 1000 > n["quality"] >= n["near_duplicates"] > n["decontaminate"] == n["redact"] > 0
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert steps["quality"].join(labels.where("quality = 1"), "doc_id").count() >= 0.99 * labels.where("quality = 1").count()
    assert steps["near_duplicates"].groupBy("text").count().where("count > 1").count() == 0
    left = [(r["doc_id"], r["text"]) for r in steps["decontaminate"].collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(t in x for _, t in items for _, x in left)
    assert personal_data.find(steps["redact"], ["doc_id"]).where("size(base) > 0").count() == 0
    texts = {r["doc_id"]: r["text"] for r in steps["redact"].collect()}
    packed = steps["pack"].withColumn("ids_crc32", F.crc32("ids")).collect()
    assert {r["doc_id"] for r in packed} == set(texts)
    check_packing(packed, texts)


def test_pipeline_stages_on_odd_documents(spark, data):
    docs = odd_docs(spark)
    for stage in (stages.quality, stages.near_duplicates, stages.decontaminate, stages.redact):
        assert stage(spark, docs, data).columns == docs.columns
        assert stage(spark, docs.limit(0), data).count() == 0
    kept = stages.near_duplicates(spark, docs, data)
    assert kept.where("doc_id in (2, 3, 6)").count() == 0 and kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 5").count() == 1
    assert stages.decontaminate(spark, docs, data).count() == 12
    packed = stages.pack(spark, docs, data)
    assert packed.select("doc_id").distinct().count() == 10 and stages.pack(spark, docs.limit(0), data).count() == 0


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_rows_are_dropped_by_text_and_id(spark, data, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_IDS", broadcast)
    line = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, line("a")), (5, line("a")), (5, line("b")), (7, line("c")), (7, line("c")), (None, line("d")), (None, line("d") + " x"), (None, line("e"))]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, keeper string")
    kept = stages.near_duplicates(spark, docs, data)
    assert pairs(kept.where("doc_id is not null"), "doc_id", "text") == sorted([(1, line("a")), (5, line("b")), (7, line("c"))], key=repr)
    assert {r["text"][:2] for r in kept.where("doc_id is null").collect()} == {"d0", "e0"} and kept.count() == 5
    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, f"x {item} y"), (None, "clean text of no item"), (3, f"x {item} y"), (3, "another clean text")], "doc_id long, text string")
    assert {r["text"] for r in stages.decontaminate(spark, docs, data).collect()} == {"clean text of no item", "another clean text"}


def test_run_equals_its_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    got = corpus_pipeline.run(spark, data)
    assert got.columns == docs.columns
    assert pairs(got.groupBy("doc_id").agg(F.sum("length").alias("n")), "doc_id", "n") == pairs(docs.groupBy("doc_id").agg(F.sum("length").alias("n")), "doc_id", "n")
