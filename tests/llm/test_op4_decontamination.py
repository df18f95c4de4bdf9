"""Tests of decontamination."""

import random

import numpy as np
from llm_cases import odd_docs

from orbweave.llm import decontamination


def brute_leaks(docs, items):
    out = {}
    for i, t in items:
        si = decontamination.shingles_of(w := decontamination.words_of((t or "").encode()))
        for d, x in docs:
            words = decontamination.words_of((x or "").encode())
            best = max((decontamination.similarity(decontamination.shingles_of(words[p : p + len(w)]), si) for p in range(max(1, len(words)))), default=0)
            if si and best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"wort{i}" for i in range(300)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.randint(5, 60))) for i in range(25)] + [(90, None), (91, ""), (92, "only four words here"), (93, line(40))]
    items.append((94, items[3][1]))
    docs = [(i, line(rng.randint(0, 80))) for i in range(60)] + [(900, None), (901, ""), (902, "short one")]
    for i in range(24):
        w = items[i][1].split()
        if i % 3 == 1 and len(w) > 20:
            w[len(w) // 2 : len(w) // 2 + 1] = ["neu"] if i % 2 else ["ganz", "neu"]
        if i % 3 == 2:
            w = [x.upper() + "," for x in w]
        if i % 4 == 0:
            w = w[1:]
        docs.append((100 + i, f"{line(rng.randint(0, 30))} {' '.join(w)} {line(rng.randint(0, 30))}"))
    d = spark.createDataFrame([(*x, 1, 2) for x in docs] + [(*docs[-1], 1, 2)], "doc_id long, text string, size int, k int")
    b = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, fp int")
    want = brute_leaks(docs, items)
    assert len(want) >= 15

    def got():
        return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontamination.leaks(d, b).collect()}

    found = got()
    assert all(want[k] == v for k, v in found.items()) and len(found) >= 0.95 * len(want)
    assert all(k in found for k, v in want.items() if v >= 0.87)
    with monkeypatch.context() as m:
        m.setattr(decontamination, "PASS_ITEMS", 7)  # several passes
        assert got() == found
    with monkeypatch.context() as m:
        m.setattr(decontamination, "STRETCH", 8)
        m.setattr(decontamination, "TOGETHER", 3)
        assert got() == found
    assert decontamination.leaks(d.limit(0), b).count() == 0 and decontamination.leaks(d, b.limit(0)).count() == 0
    assert decontamination.leaks(odd_docs(spark), b).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(8)
    cuts = decontamination.blocks(16)
    assert sum(n for _, n in cuts) == 64 and len(cuts) == 17
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 16):
            y ^= 1 << bit
        assert any((x >> a) % (1 << n) == (y >> a) % (1 << n) for a, n in cuts)


def test_sliding_windows_equal_single_ones():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(5, 40))]
        item = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(5, 15))]
        starts = rng.sample(range(len(words) - 4), rng.randint(1, len(words) - 4))
        every = [(decontamination.similarity(decontamination.shingles_of(words[s : s + len(item)]), decontamination.shingles_of(item)), -s) for s in starts]
        got = decontamination.best_window(words, starts, item)
        assert (got[0], -got[1]) == max(every)


def test_a_very_long_item_costs_what_its_words_are(spark):
    """20,000 words found in a document of as many: the worker's memory grows with the words, not with their square."""
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 9000)}" for _ in range(20_000)]
    text = " ".join(words)
    changed = list(words)
    for i in range(0, 20_000, 100):
        changed[i] = "neu"
    docs = spark.createDataFrame([(1, "vor " + text + " nach"), (2, " ".join(changed)), (3, " ".join(words[:9000])), (None, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (8, text.upper())], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], round(r["similarity"], 3)) for r in decontamination.leaks(docs, items).collect()}
    assert set(got) == {(d, i) for d in (1, 2, None) for i in (7, 8)} and got[1, 7] == (1, 1.0) and got[2, 8][1] > 0.9

    import tracemalloc

    from orbweave.llm.shingles import shingle_hashes, word_hashes

    h, _ = shingle_hashes(*word_hashes([text.encode()]), 5)
    index = decontamination.Index(np.unique(h), np.full(len(np.unique(h)), 20_000), 0.8)
    tracemalloc.start()
    n = sum(len(w[0]) for w in index.windows(*word_hashes([text.encode()])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1000 and peak < 300 << 20
