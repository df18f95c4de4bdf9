"""Operator 6: quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose value exceeds a cutoff. Cutoffs come from labelled holdouts: for every stratum (language) and
rule, a candidate cutoff is admitted only if the exact binomial upper bound on its false rejections of good documents, at a
confidence corrected for all (stratum, rule, cutoff) tests (Bonferroni), stays within the rule's share of ALPHA. The rules'
shares add up to ALPHA, so all rules together falsely reject at most ALPHA of a stratum's good documents. The lowest admitted
cutoff is used; a rule with none never rejects. With x of n good documents rejected, the Clopper-Pearson bound at confidence
1 - delta is at most alpha exactly when P(Binomial(n, alpha) <= x) <= delta, so that tail is what is computed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, let, materialise, table, text_or_empty, words

#: Good documents of a stratum that all rules together may reject at most, as a share.
ALPHA = 0.02
#: Chance that any admitted cutoff of any stratum breaks ALPHA.
DELTA = 0.05
RULES = ["symbols_per_word", "dup_line_share", "repeat_word_share", "mean_word_length"]
CUTOFFS = {
    "symbols_per_word": [0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0],
    "dup_line_share": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_word_share": [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3],
    "mean_word_length": [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
}
#: What one rule may reject.
RULE_ALPHA = ALPHA / len(RULES)
N_TESTS = sum(map(len, CUTOFFS.values()))
WINDOW = 5
#: Strata up to this many are joined by broadcast.
BROADCAST_STRATA = 10_000


def repeat_words(w: Column) -> Column:
    """Words of the array in 5-word windows that occur twice or more in it, the first occurrence included."""
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        hit = lambda s: F.filter(
            s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        )
        places = let(pairs, lambda s: F.sort_array(F.transform(hit(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(places, covered))

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows(w), repeated)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (lang; null: empty), sig (a hash of the text) and the counts of each row of ``docs`` (doc_id, lang, text).

    A null text counts as an empty one: no words, no lines. Repeated rows are measured each. A very long text is one row and is read
    whole. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE_WORD))
    counted = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("stratum"),
        F.xxhash64(text).alias("sig"),
        let(words(text, SPACE_WORD), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("own"))).alias("lines"),
    )
    return counted.select(
        "doc_id", "stratum", "sig", "w.n_words", "word_chars", "n_symbols",
        (F.col("lines.all") - F.col("lines.own")).alias("n_dup_lines"), "w.n_repeat_words", F.col("lines.all").alias("n_lines"),
    )


def values() -> dict[str, Column]:
    """The value that each rule compares with its cutoff; null where there is nothing to divide by, and then it never rejects."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"),
        "mean_word_length": share("word_chars", "n_words"),
    }


def _lgamma(z: Column) -> Column:
    """log Gamma for z >= 1: the Stirling series at z + 9, brought down by the recurrence."""
    low = F.log(z)
    for i in range(1, 9):
        low = low + F.log(z + i)
    y = z + 9.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - low


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= x); 1 where x is over the mean, as no bound is met there. Terms fall off geometrically below the mean."""
    log_top = _lgamma(n + 1.0) - _lgamma(x + 1.0) - _lgamma(n - x + 1.0) + x * math.log(p) + (n - x) * math.log1p(-p)
    terms = F.least(x, F.ceil(F.sqrt(n * p) * 12 + 60)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] * (x - j + 1) / (n - x + j) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), start, add, lambda a: a["sum"])
    return F.when(x > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * total))


def thresholds(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_rejected for the lowest admitted cutoff of each stratum and rule.

    labels: doc_id, quality. A document labelled more than once is good only if all its labels say so; null labels are ignored.
    The bound holds for independent draws, so equal texts of a stratum are one draw, however many rows or doc_ids they have: it is in
    the holdout if one of its rows is good. (Near copies still count each.)
    """
    spark = measured.sparkSession
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    # equal texts have equal values, so any of their rows stands for them
    held = measured.join(good, "doc_id", "left_semi").dropDuplicates(["stratum", "sig"])
    # a value's bucket is the number of cutoffs below it
    bucket = lambda r, v: sum(((F.coalesce(v, F.lit(0.0)) > c).cast("int") for c in CUTOFFS[r]), F.lit(0))
    each = held.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(r, v).alias("bucket")) for r, v in values().items()])).alias("x"))
    buckets = materialise(each.groupBy("stratum", "x.rule", "x.bucket").agg(F.count("*").alias("n")), "buckets")
    n_strata = buckets.select("stratum").distinct().count()
    grid = spark.createDataFrame([(r, i + 1, float(c)) for r, cs in CUTOFFS.items() for i, c in enumerate(cs)], "rule string, nth int, cutoff double")
    strata = buckets.groupBy("stratum", "rule").agg(F.sum("n").alias("n_good"))
    tests = strata.join(F.broadcast(grid), "rule")
    tests = tests.join(buckets, ["stratum", "rule"]).groupBy("stratum", "rule", "nth", "cutoff", "n_good").agg(
        F.sum(F.when(F.col("bucket") >= F.col("nth"), F.col("n")).otherwise(0)).alias("n_rejected")
    )
    tail = binomial_tail(F.col("n_rejected").cast("double"), F.col("n_good").cast("double"), RULE_ALPHA)
    admitted = tests.where(tail <= DELTA / max(1, N_TESTS * n_strata))
    return admitted.groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n_good", "n_rejected")).alias("x")).select("stratum", "rule", "x.*")


def apply_rules(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept. A stratum without labelled documents has no cutoffs and keeps all that the base rules keep."""
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    if wide.count() <= BROADCAST_STRATA:
        wide = F.broadcast(wide)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rejects = [F.coalesce(v > F.col(f"cut_{r}"), F.lit(False)) for r, v in values().items()]
    out = measured.join(wide, "stratum", "left").withColumn("base_failed", failed)
    any_rule = rejects[0]
    for r in rejects[1:]:
        any_rule = any_rule | r
    return out.withColumn("kept", ~(F.col("base_failed") | any_rule))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialise(measure(table(spark, sf_dir, "documents")), "measured")
    cutoffs = materialise(thresholds(measured, table(spark, sf_dir, "labels")), "cutoffs")
    return apply_rules(measured, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    grid = ", ".join(f"('{r}', {i + 1}, {c}::double)" for r, cs in CUTOFFS.items() for i, c in enumerate(cs))
    a, b = math.log(RULE_ALPHA), math.log1p(-RULE_ALPHA)
    return rf"""
with d as (
  select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') as s from (select doc_id, w, unnest(range(0, len(w) - 4)) as i from d where len(w) > 4)),
rep as (select doc_id, s from win group by all having count(*) > 1),
pos as (select doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) as p from win semi join rep using (doc_id, s)),
nrep as (select doc_id, count(distinct p) as n_repeat_words from pos group by 1),
lines as (select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
nline as (select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines group by 1),
m as (
  select doc_id, stratum, text, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from d left join nrep using (doc_id) left join nline using (doc_id)),
good as (select doc_id from labels where quality is not null group by 1 having min(quality) = 1),
vals as (
  select doc_id, stratum, text, unnest(['symbols_per_word', 'dup_line_share', 'repeat_word_share', 'mean_word_length']) as rule,
         unnest([n_symbols::double / nullif(n_words, 0), n_dup_lines::double / nullif(n_lines, 0),
                 n_repeat_words::double / nullif(n_words, 0), word_chars::double / nullif(n_words, 0)]) as v
  from m),
grid(rule, nth, cutoff) as (values {grid}),
tests as (
  select stratum, g.rule, cutoff, count(*) as n, count(*) filter (coalesce(v, 0) > cutoff) as x
  from (select distinct stratum, text, rule, v from vals semi join good using (doc_id)) join grid g using (rule) group by all),
judged as (
  select *, case when x > n * {RULE_ALPHA} then 1.0 else list_sum(list_transform(range(0, x + 1), lambda k:
      exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * {a!r} + (n - k) * {b!r}))) end as tail,
    (select count(distinct stratum) from tests) as n_strata from tests),
cuts as (select stratum, rule, min(cutoff) as cutoff from judged where tail <= {DELTA} / ({N_TESTS} * n_strata) group by all),
bad as (select distinct doc_id from vals join cuts using (stratum, rule) where v > cutoff)
select m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and b.doc_id is null as kept
from m left join bad b on m.doc_id = b.doc_id
"""


ORACLE = {"op6_quality_rules": _oracle()}
