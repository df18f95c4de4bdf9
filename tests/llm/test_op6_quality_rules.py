"""Tests of quality rules."""

import random
from collections import Counter

from llm_cases import odd_docs, pairs, same_count
from pyspark.sql import functions as F

from orbweave.llm import quality_rules


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(float(x), float(n)) for n in (1, 5, 60, 900, 3000) for x in (0, 1, 2, 7, 20, n) if x <= n]
    df = spark.createDataFrame(cases, "x double, n double").select("x", "n", quality_rules.binomial_tail(F.col("x"), F.col("n"), 0.01).alias("p"))
    for r in df.collect():
        n, x = int(r["n"]), int(r["x"])
        want = 1.0 if x > n * 0.01 else sum(comb(n, k) * 0.01**k * 0.99 ** (n - k) for k in range(x + 1))
        assert abs(r["p"] - want) < 1e-9


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["a b c d e a b c d e", "x " * 5, "x " * 6]

    def brute(t):
        w = t.split()
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(win)
        return len({i + j for i, x in enumerate(win) if n[x] > 1 for j in range(5)})

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("x"))
    assert dict(pairs(quality_rules.measure(df), "doc_id", "n_repeat_words")) == {i: brute(t) for i, t in enumerate(texts)}


def test_rules_on_odd_documents(spark):
    docs, labels = odd_docs(spark), spark.createDataFrame([(4, 1), (5, 1), (None, 1), (6, None)], "doc_id long, quality int")
    measured = quality_rules.measure(docs)
    out = quality_rules.apply_rules(measured, quality_rules.thresholds(measured, labels))
    same_count(out)
    assert out.where("doc_id = 1").first()["base_failed"] and not out.where("doc_id = 3").first()["kept"]
    assert quality_rules.apply_rules(measured.limit(0), quality_rules.thresholds(measured.limit(0), labels)).count() == 0


def test_false_rejections_stay_within_the_bound(spark):
    """Cutoffs from one half of a table of good documents with scattered values; the other half is what they promise to spare."""
    value = (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) / (1 << 20)).cast("double")
    skewed = (F.pow(value, F.lit(300.0)) * 400).cast("long")
    rows = spark.range(24_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 2).alias("stratum"), F.xxhash64("id").alias("sig"), F.lit(200).cast("long").alias("n_words"),
        (F.lit(900) + 3 * skewed).alias("word_chars"), skewed.alias("n_symbols"), (skewed % 60).alias("n_dup_lines"), (skewed % 41).alias("n_repeat_words"), F.lit(100).cast("long").alias("n_lines"),
    )
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    labels = rows.where(half).select("doc_id", F.lit(1).alias("quality"))
    cutoffs = quality_rules.thresholds(rows, labels)
    assert cutoffs.select("stratum").distinct().count() == 2 and cutoffs.where(f"n_rejected > n_good * {quality_rules.RULE_ALPHA}").count() == 0
    for r in quality_rules.apply_rules(rows.where(~half), cutoffs).where("not base_failed").groupBy("stratum").agg(F.avg((~F.col("kept")).cast("double")).alias("lost")).collect():
        assert 0 < r["lost"] <= quality_rules.ALPHA


def test_few_labels_admit_no_cutoff_and_many_strata_need_no_broadcast(spark, data, monkeypatch):
    measured = quality_rules.measure(spark.read.parquet(f"{data}/documents.parquet"))
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert quality_rules.thresholds(measured, labels).count() == 0
    cutoffs = spark.createDataFrame([("de", "symbols_per_word", 0.05, 9, 0), ("en", "mean_word_length", 6.0, 9, 0)], "stratum string, rule string, cutoff double, n_good long, n_rejected long")
    want = pairs(quality_rules.apply_rules(measured, cutoffs), "doc_id", "kept")
    monkeypatch.setattr(quality_rules, "BROADCAST_STRATA", 0)
    assert pairs(quality_rules.apply_rules(measured, cutoffs), "doc_id", "kept") == want
    assert {False, True} == {k for _, k in want}


def test_copies_are_one_draw(spark):
    """One document repeated 10,000 times, under as many doc_ids, says no more than one; as many different ones admit a cutoff."""
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    labels = rows.select("doc_id", F.lit(1).alias("quality"))
    text = "a plain text of a few words that is quite good"
    copies = quality_rules.measure(rows.withColumn("text", F.lit(text)))
    assert quality_rules.thresholds(copies, labels).count() == 0
    distinct = quality_rules.measure(rows.withColumn("text", F.concat(F.lit(text + " "), F.col("doc_id").cast("string"))))
    assert quality_rules.thresholds(distinct, labels).count() == len(quality_rules.RULES)
