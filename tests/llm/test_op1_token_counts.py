"""Tests of token counts."""

from collections import Counter

from llm_cases import odd_docs, pairs
from pyspark.sql import functions as F

from orbweave.llm import token_counts
from orbweave.llm.queries import QUERIES


def test_token_totals_equal_a_recount(spark, data, duck):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for s, l, t in duck.execute("select source, lang, text from documents").fetchall():
        want[s, l, "docs"] += 1
        want[s, l, "tokens"] += len(enc.encode_ordinary(t or ""))
    got = QUERIES["op1_token_counts"](spark, data).collect()
    assert {(r["source"], r["lang"]) for r in got} == {k[:2] for k in want}
    assert all(want[r["source"], r["lang"], "docs"] == r["n_docs"] and want[r["source"], r["lang"], "tokens"] == r["n_tokens"] for r in got)


CHANGES = "op string, doc_id long, tokenizer string, source string, lang string, tokens long, seq int"


def test_ledger_nets_out_and_batches_are_idempotent(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "l"))
    assert ledger.totals().count() == 0 and ledger.current().count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), CHANGES)
    first = rows(("insert", 1, "t", "a", "en", 10, 0), ("insert", 2, "t", "a", "en", 5, 0), ("insert", 3, "t", None, None, None, 0), ("insert", None, "t", "a", "en", 99, 0), ("nonsense", 4, "t", "a", "en", 9, 0), ("insert", 1, "t2", "a", "en", 4, 0))
    assert ledger.apply(1, first) and not ledger.apply(1, first)
    assert pairs(ledger.totals(), "source", "lang", "tokenizer", "n_docs", "n_tokens") == sorted([("a", "en", "t", 2, 15), ("a", "en", "t2", 1, 4), (None, None, "t", 1, 0)], key=repr)
    ledger.apply(2, rows(("revise", 1, "t", "b", "en", 7, 0), ("delete", 2, "t", None, None, None, 1), ("insert", 2, "t", "a", "en", 50, 0), ("delete", 77, "t", "a", "en", 1, 0)))
    assert pairs(ledger.totals().where("source is not null and tokenizer = 't'"), "source", "n_docs", "n_tokens") == [("b", 1, 7)]
    # a batch that broke off before its marker is invisible, and the next try replaces it
    spark.createDataFrame([(9, "z", "en", "t", 1, 1000)], "doc_id long, source string, lang string, tokenizer string, docs long, tokens long").write.parquet(str(tmp_path / "l/ledger/batch=3/bucket=5"))
    assert ledger.current().where("doc_id = 9").count() == 0
    ledger.apply(3, rows(("insert", 9, "t", "b", "en", 1, 0), ("insert", 9, "t", "b", "en", 2, 1)))
    assert pairs(ledger.totals().where("source = 'b'"), "n_docs", "n_tokens") == [(2, 9)]
    ledger.apply(4, rows().limit(0))
    assert ledger.totals().where("source = 'b'").first()["n_tokens"] == 9


def test_token_counts_of_odd_documents(spark):
    got = dict(pairs(token_counts.count_tokens(odd_docs(spark), ["doc_id"]).where("doc_id is not null and doc_id not in (5)"), "doc_id", "n_tokens"))
    assert got[1] == got[2] == 0 and got[4] == 1 and got[7] > 60_000
    assert token_counts.count_tokens(odd_docs(spark).limit(0), ["doc_id"]).count() == 0


def test_token_totals_hold_rows_without_an_id(spark, tmp_path):
    rows = [(None, "alpha beta", "z"), (1, "alpha beta", "a"), (2, "one", "a"), (None, "gamma", "a"), (None, "gamma", "a"), (None, None, "a"), (None, "one", "b")]
    spark.createDataFrame([(i, t, s, "en") for i, t, s in rows], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_token_counts"](spark, str(tmp_path))
    n = {t: token_counts.count_tokens(spark.createDataFrame([(t,)], "text string"), ["text"]).first()["n_tokens"] for t in ("alpha beta", "one", "gamma")}
    # the repeated row counts once
    assert pairs(got, "source", "lang", "n_docs", "n_tokens") == [("a", "en", 4, sum(n.values())), ("b", "en", 1, n["one"]), ("z", "en", 1, n["alpha beta"])]


def inserts(spark, n):
    return spark.range(n).select(F.lit("insert").alias("op"), F.col("id").alias("doc_id"), F.lit("t").alias("tokenizer"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("tokens"), F.lit(0).alias("seq"))


def test_a_small_batch_reads_its_folders_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "FOLDER_ROWS", 16)
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "l"))
    many = inserts(spark, 4000)
    ledger.apply(1, many)
    some = many.where("doc_id % 400 = 7")
    plan = ledger.current(some)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    ledger.apply(2, some.withColumn("tokens", F.lit(10)))
    # a small batch lies in few folders, whatever the ledger's size
    assert spark.read.parquet(str(tmp_path / "l/ledger/batch=2")).select("bucket").distinct().count() == 1 and token_counts.folders_for(10) == 1
    want = [(4000, 4000 * 3 + 10 * 7)]
    assert pairs(ledger.totals(), "n_docs", "n_tokens") == want
    assert ledger.compact() == 1 and ledger.compact() == 1
    assert pairs(ledger.totals(), "n_docs", "n_tokens") == want and ledger.current().count() == 4000
    # of the compacted ledger ten documents read under a tenth, and a committed batch stays committed
    assert ledger.current(some).count() < 400 and pairs(ledger.current(some).where("doc_id % 400 = 7"), "tokens") == [(10,)] * 10
    assert not ledger.apply(2, many)
    ledger.apply(3, some.withColumn("op", F.lit("delete")))
    assert pairs(ledger.totals(), "n_docs", "n_tokens") == [(3990, 3990 * 3)]
    assert ledger.compact() == 2 and pairs(ledger.totals(), "n_docs", "n_tokens") == [(3990, 3990 * 3)] and ledger.current().count() == 3990


def test_a_broken_compaction_is_invisible(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "l"))
    ledger.apply(1, inserts(spark, 50))
    # all but the marker
    junk = spark.createDataFrame([(9, "z", "en", "t", 1, 1000)], "doc_id long, source string, lang string, tokenizer string, docs long, tokens long")
    junk.write.parquet(str(tmp_path / "l/bases/base=1/ledger/bucket=0"))
    junk.drop("doc_id").write.parquet(str(tmp_path / "l/bases/base=1/totals"))
    assert pairs(ledger.totals(), "n_docs", "n_tokens") == [(50, 150)] and ledger.current().count() == 50
    assert ledger.compact() == 1
    assert pairs(ledger.totals(), "n_docs", "n_tokens") == [(50, 150)] and ledger.current().where("source = 'z'").count() == 0
    assert token_counts.TokenLedger(spark, str(tmp_path / "none")).compact() == 0


def test_folders_grow_with_rows():
    n = token_counts.FOLDER_ROWS
    assert [token_counts.folders_for(x) for x in (0, 1, n, n + 1, 2 * n + 1, 5 * n, 10**13)] == [1, 1, 1, 2, 4, 8, token_counts.MOST_FOLDERS]


def test_changes_with_further_columns(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "l"))
    rows = spark.createDataFrame([("insert", 1, "t", "a", "en", 10, 0, 5, 9, "x", 1)], CHANGES + ", docs long, bucket int, batch string, x int")
    assert ledger.apply(1, rows) and pairs(ledger.totals(), "n_docs", "n_tokens") == [(1, 10)] and pairs(ledger.current(), "doc_id", "tokens") == [(1, 10)]
