"""Tests of licence scans."""

import random
import re

import pytest
from llm_cases import odd_docs, pairs, same_count

from orbweave.llm import license_scans


def test_licences_in_odd_documents(spark):
    texts = ["MIT License. Apache-License, cc by", "the gnu general public license; gnu general public licence", "mit  license mit license", "Licensed under the great Apache License version 2.0", "released under the mit", None, "", "x"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 1)], "doc_id long, text string, tid int")
    spans, documents = license_scans.scan_licenses(df)
    got = pairs(documents, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    assert got[0] == (0, 6, 3, 0, 4, "apache,cc-by,mit", "apache,cc-by,mit")
    assert got[1][:6] == (1, 9, 1, 1, 1, "gpl")
    assert got[2] == got[3] == (2, 4, 2, 0, 2, "mit", "mit")
    # a word put into a notice moves the rest to the next diagonal
    assert got[4][5:] == ("apache", "apache,apache-2.0")
    assert got[5][2:] == (0, None, None, "", "") and got[6] == (5, 0, 0, None, None, "", "")
    scores = dict(pairs(documents, "doc_id", "score"))
    assert 0 < scores[4] < 1 and scores[5] == 0 and scores[0] == 1
    assert spans.where("label = 'apache-2.0'").first()["score"] >= license_scans.COVER
    same_count(license_scans.scan_licenses(odd_docs(spark))[1])
    assert license_scans.scan_licenses(df.limit(0))[1].count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute_scan(text, rows):
    """(labels, base labels, score) by trying every diagonal of every template."""
    w = re.findall(license_scans.ALNUM_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, base, top = set(), set(), 0.0
    for _, phrase, label, exact in rows:
        t = phrase.split(" ")
        grams = len(t) - 1
        for d in range(-len(t), len(w)):
            reach = 0 if exact else license_scans.DRIFT
            if not any(w[p : p + 2] == t[p - d : p - d + 2] for p in range(max(d, 0), min(len(w) - 1, d + grams))):
                continue
            hits = [(p, o) for o in range(grams) for p in range(max(0, o + d), min(len(w) - 1, o + d + reach + 1)) if w[p : p + 2] == t[o : o + 2]]
            score = len({o for _, o in hits}) / grams
            if not exact and score >= license_scans.COVER:
                a, z = min(p for p, _ in hits), max(p for p, _ in hits) + 2
                score = min(score, max(0.0, 1 - levenshtein([x if x in t else None for x in w[a:z]], t) / len(t)))
            top = max(top, score)
            if score >= (1 if exact else license_scans.COVER):
                labels.add(label)
                if exact:
                    base.add(label)
    return ",".join(sorted(labels)), ",".join(sorted(base)), round(top, 6)


def test_spans_equal_brute_force(spark):
    rng = random.Random(3)
    rows = license_scans.templates()
    vocabulary = sorted({x for _, p, _, _ in rows for x in p.split(" ")}) + ["zebra"]
    texts = ["all rights all rights", "all rights, all rights were kept", "all rights reserved", "all rights rights reserved", "mit license " * 4, "license version " * 10, "released under the mit license"]
    for _ in range(250):
        w = list(rng.choice(rows)[1].split(" "))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(w) + 1)
            how = rng.random()
            if how < 0.4:
                w.insert(at, rng.choice(vocabulary))
            elif how < 0.7 and len(w) > 1:
                del w[min(at, len(w) - 1)]
            elif how < 0.85:
                w[at:at] = w[max(0, at - 3) : at]
            else:
                w += rng.choice(rows)[1].split(" ")
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(vocabulary[:12]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    _, documents = license_scans.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: (r["labels"], r["base_labels"], r["score"]) for r in documents.collect()}
    assert got == {i: brute_scan(t, rows) for i, t in enumerate(texts)}
    assert [got[i][0] for i in range(4)] == ["", "", "all-rights-reserved", ""] and got[4][:2] == ("mit", "mit") and got[5][0] == "" and "mit-notice" in got[6][0]


def test_templates_of_ones_own(spark):
    rows = [(0, "free words", "short", False), (1, "one two three four five", "long", False)]
    texts = ["free words", "so free words are", "one two three four five", "one two three x four five", "one two", ""]
    _, documents = license_scans.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rows)
    got = {r["doc_id"]: (r["labels"], r["base_labels"], r["score"]) for r in documents.collect()}
    assert got == {i: brute_scan(t, rows) for i, t in enumerate(texts)} and got[1][0] == "short" and got[2][0] == "long"


@pytest.mark.parametrize("how", ["in the plan", "joined"])
def test_long_templates_give_rows_of_fixed_width(spark, monkeypatch, how):
    """Full texts of 5,000 words: found with words put in and left out, by rows that are no wider than those of short templates."""
    if how == "joined":
        monkeypatch.setattr(license_scans, "WORDS_IN_PLAN", 10)
        monkeypatch.setattr(license_scans, "BROADCAST_GRAMS", 10)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(1500)]
    long = [[rng.choice(vocabulary) for _ in range(5000)] for _ in range(3)]
    rows = [(i, " ".join(w), f"license-{i}", False) for i, w in enumerate(long)] + [(3, "one two", "short", True)]
    put_in, left_out, changed = long[0][:900] + ["new", "words"] + long[0][900:], long[1][:3000] + long[1][3001:], list(long[2])
    for at in range(0, 5000, 40):
        changed[at] = "x"
    half = long[2][:2500]
    texts = ["before it " + " ".join(put_in) + " after it", " ".join(left_out), " ".join(changed), " ".join(half), "one two", None]
    spans, documents = license_scans.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rows)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in documents.collect()}
    assert [got[i][0] for i in range(6)] == ["license-0", "license-1", "license-2", "", "short", ""]
    assert got[0][1] == round(1 - 2 / 5000, 6) or got[0][1] > 0.999
    assert got[1][1] > 0.999 and abs(got[2][1] - (1 - 2 * 125 / 4999)) < 0.01 and abs(got[3][1] - 0.5) < 0.01
    assert len(license_scans._coded(" ".join(f"v{i}" for i in range(60_000)))[1]) == 60_000
