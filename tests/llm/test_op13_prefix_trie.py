"""Tests of the trie of conversations."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import prefix_trie as pt
from orbweave.llm.running import running

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 int, n_convs string"


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        full = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(full) + 1):
            nodes[tuple(full[:d])].append((c, d == len(full)))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, m in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c, e in m if e)))
        up = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(c for c, _ in m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "n") for r in rows], SCHEMA)


def test_odd_conversations(spark):
    long_text = " ".join(f"w{i}" for i in range(50_000))
    rows = [
        (0, 0, "user", "hello there"), (0, 1, "bot", "hi"), (0, 2, "user", "more"), (1, 0, "user", "x"), (1, 1, "bot", None), (1, 2, None, "y"), (1, 3, "u", "z z"),
        (2, None, "user", "null turn"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 5, None, None), (4, 0, "user", long_text), (None, 0, "user", "nobody"),
        (25, 0, "user", "no base"), (25, 1, "bot", "b"), (26, 0, "user", "no base"), (-5, 0, "user", "hello there"), (-45, 0, "u", "v"), (-40, 0, "user", "hello there"),
        *[(c, t, "user", f"{t} same words") for c in range(100, 119) for t in range(5)], *[(200 + c, 0, "user", "one") for c in range(40)],
    ]
    assert got(pt.prefix_trie(table_of(spark, rows))) == brute(rows)
    assert pt.prefix_trie(table_of(spark, rows).limit(0)).count() == 0
    assert pt.prefix_trie(table_of(spark, [(None, 0, "user", "nobody")])).count() == 0


@pytest.mark.parametrize("block", [2, 4096])
def test_long_conversations_and_deep_branches(spark, block):
    """One conversation holds a third of all rows, others leave it at many depths; with small blocks all of it goes over blocks."""
    rng = np.random.default_rng(5)
    rows = [(0, t, "user", f"turn {t}") for t in range(40)]
    for c in range(20, 400, 20):
        cut = int(rng.integers(0, 40))
        rows += [(c, t, "user", f"turn {t}") for t in range(cut)] + [(c, cut + t, "bot", f"own {c % 60} {t}") for t in range(int(rng.integers(0, 4)))]
    rows += [(c, t, "user", f"turn {t}") for c in range(401, 420) for t in range(3)]
    assert got(pt.prefix_trie(table_of(spark, rows), block)) == brute(rows)


def test_running_aggregates_over_blocks(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("key"), F.floor(F.col("id") / 3).alias("at"), F.xxhash64("id").alias("v"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("m"))
    what = {"x": (F.col("v"), "xor"), "s": (F.col("v") % 1000, "sum"), "top": (F.col("m"), "max")}
    one, many = (sorted(map(tuple, running(rows, ["key"], F.col("at"), 333, what, b).collect()), key=repr) for b in (4096, 10))
    assert one == many and len(one) == 1000


def test_ends_of_a_hot_node_go_through_the_hash_in_pieces(spark):
    ids = list(range(25_000))
    ends = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 7)], "depth long, k1 long, k2 long, conv_id long").repartition(5)
    found = {r["k2"]: r["ends_sha256"] for r in pt._ends(ends).collect()}
    assert found == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"7").hexdigest()}
