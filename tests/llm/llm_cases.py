"""Tables and brute-force versions that several test modules share."""

import re
import zlib
from collections import Counter

import numpy as np

from orbweave.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, key string, host string, rule string, score string, size string, pos int"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def odd_docs(spark):
    """Nulls in every column, empty, blank, very long and repeated rows, ties, and columns with names of the operators' own."""
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Same text, same text"), (5, "Same text, same text"), (6, "Same text, same text"), (None, "no id here"), (None, None), (7, LONG), (8, "É x ++ \x00 <|endoftext|> ok"), (9, "a" * 200_000)]
    rows = [(i, t, None if i == 2 else "en", None if i == 3 else "s", None, 3, "k", "h", "r", "x", "y", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def pairs(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def same_count(df):
    assert df.count() == 12


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    by = Counter()
    for r in sorted(rows, key=lambda r: (repr(r["doc_id"]), r["start"])):
        ids = np.array(whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert r["start"] == by[r["doc_id"]] and r["doc_tokens"] == len(ids) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        by[r["doc_id"]] += r["length"]
    assert all(by[d] == len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.LIMIT
    return sum(by.values()) / (packing.LIMIT * len(sequences))


def brute_similar(docs):
    """Groups by links of 0.8 or more of the distinct five-word shingles."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both * 5 >= 4 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {docs[i][0]: docs[find(i)][0] for i in range(len(docs))}
