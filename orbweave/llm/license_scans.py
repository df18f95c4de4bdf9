"""Operator 3: licence scans by diagonal voting.

All rolling word k-gram hashes of a document are joined to the positions that they have in the templates. A hit at document
word p and template offset o votes for the diagonal p - o. Each diagonal with a vote opens a span, into which the neighbouring
diagonals up to DRIFT further on (small insertions) are merged; the span's vote is the number of *distinct* template offsets that
it hits, so a k-gram that repeats counts once. A span that hits COVER of them is then verified: the document's words from its
first hit to its last are compared with the whole template by edit distance over words. Its score is the lesser of the share of
offsets hit and the share of words that agree, and it counts from COVER on; a span with fewer hits scores their share.

Verification reads the texts that have such a span once more, so a hit carries nothing but its place. The join confirms the words themselves beside their hash, and an exact phrase must have all its votes on one diagonal, so that
it is an exact occurrence.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ROW_KEY, ascii_lower, keep_rows, materialise, row_key, table, text_or_empty, words

K = 2
#: Diagonals of a span lie at most this far apart, all in all.
DRIFT = 2
#: Share of a template's k-grams that a span must hit, and of its words that must agree.
COVER = 0.8
#: Different words of templates at one place of a k-gram that stand in the plan, and places of templates that are broadcast, at most.
WORDS_IN_PLAN, BROADCAST_GRAMS = 2000, 1_000_000
#: Phrases that count exactly, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Notices that count when covered in part, with labels of the method's own.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("released under the mit license", "mit-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under a creative commons attribution", "cc-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-notice"),
    ("all rights reserved", "all-rights-reserved"),
]


def templates() -> list[tuple[int, str, str, bool]]:
    """(template id, words, label, whether it must be exact)."""
    return [(i, p, l, i < len(PHRASES)) for i, (p, l) in enumerate(PHRASES + NOTICES)]


def _gram_rows(rows: list[tuple[int, str, str, bool]]) -> list[tuple[str, list[tuple[int, int]]]]:
    at: dict[str, list[tuple[int, int]]] = {}
    for i, p, _, _ in rows:
        w = p.split(" ")
        for o in range(len(w) - K + 1):
            at.setdefault(" ".join(w[o : o + K]), []).append((i, o))
    return list(at.items())


def _grams(w: Column, nth: list[list[str]] | None) -> Column:
    """(position, hash, words) of every rolling k-gram of the word array; with ``nth`` only of those whose every word is among the words that templates have there."""

    def one(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(w, i + j) for j in range(K)])

    at = F.sequence(F.lit(0), F.size(w) - K)
    if nth is not None:
        at = F.filter(at, lambda i: functools.reduce(operator.and_, [F.get(w, i + j).isin(nth[j]) for j in range(K)]))
    grams = F.transform(at, lambda i: F.struct(i.alias("pos"), one(i).alias("g")))
    return F.when(F.size(w) >= K, F.transform(grams, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["g"]).alias("h"), x["g"].alias("g"))))


def _coded(phrase: str) -> tuple[dict[str, str], str]:
    """A letter for each different word of a template, and the template in these letters."""
    letters: dict[str, str] = {}
    for w in phrase.split(" "):
        code = 0x4E00 + len(letters) + 1
        letters.setdefault(w, chr(code if code < 0xD800 else code + 0x800))  # past the surrogates
    return letters, "".join(letters[w] for w in phrase.split(" "))


#: The letter of a word that a template doesn't have.
_OTHER = chr(0x4E00)


def _agreement(docs: DataFrame, spans: DataFrame, names: DataFrame) -> DataFrame:
    """The row's key, tid, start, agree of the given spans: the share of the template's words that the span's words have, by edit distance.

    Only the texts with such a span are read again, each once; a span takes its words from there.
    """
    texts = keep_rows(docs.select("text", *row_key()), spans.select(*ROW_KEY)).dropDuplicates(ROW_KEY)
    texts = texts.select(*ROW_KEY, words(ascii_lower(text_or_empty()), ALNUM_WORD).alias("w"))
    met = spans.join(texts, ROW_KEY).join(names.select("tid", "letters", "coded", "n"), "tid")
    own = F.array_join(F.transform(F.slice("w", F.col("from") + 1, F.col("length")), lambda x: F.coalesce(F.try_element_at("letters", x), F.lit(_OTHER))), "")
    return met.select(*ROW_KEY, "tid", "start", F.greatest(F.lit(0.0), 1 - F.levenshtein(own, F.col("coded")) / F.col("n")).alias("agree"))


def scan_licenses(docs: DataFrame, rows: list[tuple[int, str, str, bool]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, documents).

    docs: doc_id, text. spans: one row for each verified span (doc_id, sig, template, label, exact, start, votes, score,
    n_words); spans of one notice that overlap within DRIFT are all given. documents: one row for each document. Null and empty
    texts have no words and no spans. Equal rows stay as many as they were; documents of one doc_id and different texts are told
    apart by a hash of the text (``sig``). Very long texts give one row for each k-gram whose words templates have.

    rows: templates, of any number of words. A hit is a row of fixed width, whatever the templates' lengths. Up to WORDS_IN_PLAN
    different words stand in the plan and rule out most places before the join; up to BROADCAST_GRAMS k-grams are broadcast, more are
    joined by their hash.
    """
    spark = docs.sparkSession
    rows = templates() if rows is None else rows
    found = _gram_rows(rows)
    nth = [sorted({g.split(" ")[j] for g, _ in found}) for j in range(K)]
    nth = nth if max(map(len, nth)) <= WORDS_IN_PLAN else None
    small = F.broadcast if sum(len(h) for _, h in found) <= BROADCAST_GRAMS else (lambda df: df)
    grams = small(spark.createDataFrame(found, "gram string, hits array<struct<tid:int,off:int>>").withColumn("gram_hash", F.xxhash64("gram")))
    names = [(i, l, e, len(p.split(" ")) - K + 1, len(p.split(" ")), *_coded(p)) for i, p, l, e in rows]
    names = small(spark.createDataFrame(names, "tid int, label string, exact boolean, size int, n int, letters map<string,string>, coded string"))
    text = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("sig"), words(ascii_lower(text_or_empty()), ALNUM_WORD).alias("w"))
    text = text.select("doc_id", "sig", F.size("w").cast("long").alias("n_words"), _grams(F.col("w"), nth).alias("grams"))
    each = text.select("doc_id", "sig", "n_words", F.posexplode_outer("grams").alias("nth_gram", "x"))
    met = each.join(grams, (F.col("x.h") == F.col("gram_hash")) & (F.col("x.g") == F.col("gram")), "left")
    met = met.select("doc_id", "sig", "n_words", "nth_gram", F.col("x.pos").alias("pos"), F.posexplode_outer("hits").alias("nth", "hit"))
    # every row of a document begins with one of these, so they count its repetitions
    first = F.when((F.coalesce("nth_gram", F.lit(0)) == 0) & (F.coalesce("nth", F.lit(0)) == 0), 1).otherwise(0)
    votes = (
        met.groupBy("doc_id", "sig", "n_words", F.col("hit.tid").alias("tid"), (F.col("pos") - F.col("hit.off")).alias("diag"))
        .agg(F.collect_set("hit.off").alias("offs"), F.min("pos").alias("from"), F.max("pos").alias("to"), F.sum(first).alias("firsts"))
    )
    key = ["doc_id", "sig"]
    votes = votes.withColumn("copies", F.sum("firsts").over(Window.partitionBy(*key)))
    votes = votes.join(names.select("tid", "label", "exact", "size"), "tid", "left")
    # a notice's span takes in the diagonals after its own; an exact phrase stands on its own diagonal
    near = Window.partitionBy(*key, "tid").orderBy(F.col("diag").cast("long")).rangeBetween(0, DRIFT)
    mine = lambda own, all_: F.when(F.col("exact"), own).otherwise(all_)
    spans = votes.select(
        *key, F.xxhash64("doc_id").alias(ROW_KEY[0]), F.col("sig").alias(ROW_KEY[1]), "n_words", "copies", "tid", "label", "exact", "size", F.col("diag").alias("start"),
        F.size(F.array_distinct(mine(F.col("offs"), F.flatten(F.collect_list("offs").over(near))))).alias("votes"),
        F.min("from").over(near).alias("from"), (F.max("to").over(near) - F.min("from").over(near) + K).alias("length"),
    )
    spans = materialise(spans.withColumn("cover", F.col("votes") / F.col("size")), "spans")
    agree = _agreement(docs, spans.where(~F.col("exact") & (F.col("cover") >= COVER)).select(*ROW_KEY, "tid", "start", "from", "length").distinct(), names)
    spans = spans.join(materialise(agree, "agree"), [*ROW_KEY, "tid", "start"], "left")
    spans = spans.withColumn("score", F.when(F.col("exact") | (F.col("cover") < COVER), F.col("cover")).otherwise(F.least("cover", "agree")))
    sure = F.col("tid").isNotNull() & F.when(F.col("exact"), F.col("votes") >= F.col("size")).otherwise(F.col("score") >= COVER)
    spans = spans.withColumn("sure", F.coalesce(sure, F.lit(False)))
    base = F.col("sure") & F.col("exact")
    documents = spans.groupBy(*key, "n_words", "copies").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("sure"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.round(F.max("score"), 6), F.lit(0.0)).alias("score"),
    )
    documents = documents.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copies", "copy")
    return spans.where("sure").select(*key, "n_words", F.col("tid").alias("template"), "label", "exact", "start", "votes", "score"), documents


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = scan_licenses(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _oracle() -> str:
    values = ", ".join(f"({i}, '{p}', '{l}', {str(e).lower()})" for i, p, l, e in templates())
    letters = "_ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    code = lambda x: f"array_to_string(list_transform({x}, lambda z: substr('{letters}', coalesce(list_position(tw, z), 0) + 1, 1)), '')"
    return rf"""
with t(tid, phrase, label, exact) as (values {values}),
tw as (select tid, label, exact, string_split(phrase, ' ') as tw from t),
tgram as (select tid, off, tw[off + 1] || ' ' || tw[off + 2] as gram from (select tid, unnest(range(0, len(tw) - 1)) as off, tw from tw)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
gram as (select doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] as gram from (select doc_id, unnest(range(0, len(w) - 1)) as pos, w from d where len(w) > 1)),
hits as (select doc_id, tid, pos, off, pos - off as diag from gram join tgram using (gram)),
anchors as (select distinct doc_id, tid, exact, diag as start from hits join tw using (tid)),
spans as (
  select a.doc_id, a.tid, start, count(distinct off) as votes, min(pos) as p, max(pos) + 2 as q
  from anchors a join hits h on h.doc_id = a.doc_id and h.tid = a.tid and diag between start and start + case when exact then 0 else {DRIFT} end
  group by all),
scored as (
  select s.doc_id, label, exact, start, votes, len(tw) - 1 as size, votes::double / (len(tw) - 1) as cover,
         1 - levenshtein({code("w[p + 1 : q]")}, {code("tw")})::double / len(tw) as agree
  from spans s join tw using (tid) join d on d.doc_id = s.doc_id),
judged as (
  select *, case when exact or cover < {COVER} then cover else least(cover, greatest(0, agree)) end as score from scored),
per as (
  select doc_id, count(*) filter (exact and votes = size) as n_base, min(start) filter (exact and votes = size) as first_word,
         max(start) filter (exact and votes = size) as last_word,
         string_agg(distinct label, ',' order by label) filter (exact and votes = size) as base_labels,
         string_agg(distinct label, ',' order by label) filter (case when exact then votes = size else score >= {COVER} end) as labels,
         round(max(score), 6) as score
  from judged group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0.0)::double as score
from d left join per on d.doc_id = per.doc_id
"""


ORACLE = {"op3_license_scans": _oracle()}
