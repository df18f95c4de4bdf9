"""Tests of packing."""

import numpy as np
import pytest
from llm_cases import check_packing, odd_docs
from pyspark.sql import functions as F

from orbweave.llm import packing
from orbweave.llm.queries import QUERIES


def test_fast_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["a" + chr(c) + "b" + chr(c) + chr(c) + "1" + chr(c) + "' 's" + chr(c) + "'s" for c in range(0x300)]
    texts += ["", "it's  I'LL'd 12½² naïve <|endoftext|> x", "ΣΑΣ İi", "don''t 't't", " a\u0085b", "Aa__b--'re!!'s", "漢字 と かな", "é"]
    got = packing.WordTokenizer(packing.default_tokenizer()).ids(texts)
    assert all(list(a) == whole.encode(t, add_special_tokens=False).ids + [1] for t, a in zip(texts, got, strict=True))


def test_packing_is_a_round_trip_with_little_padding(spark, duck, data):
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert check_packing(QUERIES["op9_packing"](spark, data).collect(), texts) > 0.97


def test_packing_many_buckets_and_odd_documents(spark):
    docs = odd_docs(spark).where("doc_id is not null and doc_id != 5")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack(docs, bucket_bytes=100_000).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert len({r["sequence_id"] >> 20 for r in rows}) > 3
    check_packing(rows, texts)
    assert packing.pack(odd_docs(spark)).agg(F.sum("length")).first()[0] > sum(r["length"] for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0


def test_assignment_balances_cost():
    lengths = np.array(sorted([2048] * 3 + [1000, 900, 800, 700, 600, 50, 40, 30, 20, 10], reverse=True))
    placed = packing.assign(lengths, 2048)
    assert sum(p[2] for p in placed) == lengths.sum() and len({p[3] for p in placed}) == -(-lengths.sum() // 2048)
    assert all(p[4] + p[2] <= 2048 for p in placed)


@pytest.mark.parametrize("partitions,rows", [(200, 200), (211, 700), (3, 700)])
def test_buckets_stay_bounded_whatever_the_partitions(spark, partitions, rows):
    texts = [f"word{i} " * (150 + i % 100) for i in range(rows)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(partitions, "doc_id")
    bytes_ = sum(len(t) + 1 for t in texts) // 20
    packed = packing.pack(docs, bucket_bytes=bytes_)
    text = F.octet_length("text") * F.col("length") / F.col("doc_tokens")
    sizes = [r["b"] for r in packed.join(docs, "doc_id").groupBy(F.shiftright("sequence_id", 20).alias("bucket")).agg(F.sum(text).alias("b")).collect()]
    assert len(sizes) >= 20 and max(sizes) < 2 * bytes_


def test_repeated_rows_and_rows_without_an_id_are_packed_each(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs).withColumn("crc", F.crc32("ids")).collect()
    five = [r for r in rows if r["doc_id"] == 5]
    assert len(five) == 2 and len({(r["crc"], r["length"], r["doc_tokens"]) for r in five}) == 1 and len({(r["sequence_id"], r["offset"]) for r in five}) == 2
    none = sorted(r["doc_tokens"] for r in rows if r["doc_id"] is None)
    assert none[0] == 1 and len(none) == 2 and none[1] > 3
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 7)


def test_short_pieces_bound_a_bucket(spark):
    """A million empty and one-letter texts: no bucket gets more pieces than its bytes allow, and none is lost."""
    docs = spark.range(0, 200_000, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("text"))
    rows = packing.pack(docs, bucket_bytes=1 << 20).selectExpr("shiftright(sequence_id, 20) as bucket", "length").groupBy("bucket").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()
    assert sum(r["tokens"] for r in rows) == 300_000 and max(r["n"] for r in rows) <= 1.2 * (1 << 20) / packing.PIECE_BYTES
