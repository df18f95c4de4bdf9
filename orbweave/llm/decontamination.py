"""Operator 4: benchmark decontamination.

A document is compared with a benchmark item through windows of the item's size. A window's SimHash and an item's are looked
up through a multi-index: both are cut into RADIUS + 1 blocks, and two fingerprints within RADIUS bits agree in a block at
least. Candidates within the radius are verified by the exact similarity of their weighted word shingles (a shingle weighs as
often as it occurs; sum of minima over sum of maxima).

Which windows are looked at loses nothing. A window whose first shingle the item doesn't have can be moved on by one without
getting less similar, so every best window of an item begins with one of the item's shingles (or has none of them). And a window
can only be as similar as asked if enough of its shingles occur in some item at all.

Fingerprints of windows come from running sums of the shingles' bits, so a window costs the same whatever its size. A task hands
on a text once and its windows as numbers; the words of a candidate are cut from the text when it is verified, and all windows of
one text and item are verified in one pass over them.

Items are a table as well: their shingles and fingerprints are worked out on executors, and only the hashes of a pass (at most
PASS_WORDS, and the sizes that have them) go through the driver, to be broadcast. A benchmark of more takes more passes, each
written to the shared folder before the next begins.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialise, small_batches, table
from .packing import grouped
from .shingles import mix, shingle_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of 64. Texts of similarity 0.8 differ in 9.7 bits on average, and in 16 or fewer 99 times in 100.
RADIUS = 16
#: Distinct items, and words of them, in one pass over the documents, about: some 30 MB of broadcast each.
PASS_ITEMS = 20_000
PASS_WORDS = 2_000_000
#: Words whose running sums are held at once, and windows looked at together.
STRETCH, TOGETHER = 1 << 14, 1 << 15

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def shingles_of(w: list[bytes]) -> Counter:
    return Counter(b" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, a.total() + b.total() - both)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _prints(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHashes from how often each bit is set among n hashes."""
    return np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def simhash(h: np.ndarray) -> int:
    """Of shingle hashes, repeats included."""
    return int(_prints(_bits(h).sum(0, dtype=np.int64)[None], np.array([len(h)]))[0])


def blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(lowest bit, bits) of radius + 1 blocks over 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


class Index:
    """What a task needs to find a pass's windows: the sizes of the items that have a shingle, by its hash."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, least: float):
        order = np.argsort(hashes, kind="stable")
        self.hash, self.size, self.least = hashes[order], sizes[order], least
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.hash >> np.uint64(44)] = True

    def windows(self, words: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(first word, word after the last, item's size, SimHash) of the windows to look up, as arrays, over the words of many texts in order."""
        h, one = shingle_hashes(words, text, SHINGLE)
        maybe = np.nonzero(self.seen[h >> np.uint64(44)] & one)[0]
        low, high = np.searchsorted(self.hash, h[maybe], "left"), np.searchsorted(self.hash, h[maybe], "right")
        at, low, high = (x[high > low] for x in (maybe, low, high))
        if not len(at):
            return
        covered = np.zeros(len(h) + 1, dtype=np.int64)
        covered[at + 1] = 1
        covered = np.cumsum(covered)
        ends = np.searchsorted(text, text[at], "right")
        made = np.cumsum(high - low)
        a = 0
        while a < len(at):
            z = max(a + 1, min(int(np.searchsorted(at, at[a] + STRETCH)), int(np.searchsorted(made, made[a] + TOGETHER))))
            n = high[a:z] - low[a:z]
            pick = np.repeat(np.arange(a, z), n)
            size = self.size[np.repeat(low[a:z] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            start = at[pick]
            end = np.minimum(start + size, ends[pick])
            shingles = end - start - SHINGLE + 1
            # both of at most so many, so this is the least that the two must have in common
            common = self.least * (shingles + size - SHINGLE + 1) / (1 + self.least)
            enough = covered[start + shingles] - covered[start] >= common - 1e-6
            start, end, size, shingles = (x[enough] for x in (start, end, size, shingles))
            a = z
            if not len(start):
                continue
            first = int(start.min())
            sums = np.zeros((int((start + shingles).max()) - first + 1, 64), dtype=np.int32)
            np.cumsum(_bits(h[first : first + len(sums) - 1]), axis=0, dtype=np.int32, out=sums[1:])
            yield start, end, size, _prints(sums[start + shingles - first] - sums[start - first], shingles)


_WINDOW = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("fp", pa.int64())])
_WINDOWS = "array<struct<start:int,size:int,begin:int,end:int,fp:long>>"


def _find(shared: Broadcast, kept: list[str]):
    """For every text with a window: the kept columns, a digest of its words, the words joined, and its windows (begin and end: bytes of the joined words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            at = 0
            for texts in grouped(t.as_py() or "" for t in batch.column("text")):
                raw = [t.encode() for t in texts]
                words, owner = word_hashes(raw)
                found = [np.concatenate(x) for x in zip(*index.windows(words, owner), strict=True)] or [np.zeros(0, np.int64)] * 4
                start, end, size, fp = (x[np.argsort(found[0], kind="stable")] for x in found)
                has, cut = np.unique(owner[start], return_index=True)
                firsts = np.searchsorted(owner, has)
                joined, digest, lists = [], [], []
                for i, f, a, z in zip(has.tolist(), firsts.tolist(), cut.tolist(), np.append(cut, len(start))[1:].tolist(), strict=True):
                    own = words_of(raw[i])
                    joined.append(b" ".join(own))
                    digest.append(hashlib.md5(joined[-1]).digest())
                    byte = np.concatenate(([0], np.cumsum([len(w) + 1 for w in own])))
                    s, e = start[a:z] - f, end[a:z] - f
                    cols = [s, size[a:z], byte[s], byte[e] - 1, fp[a:z]]
                    lists.append(pa.StructArray.from_arrays([pa.array(c.astype(np.int64)).cast(t.type) for c, t in zip(cols, _WINDOW, strict=True)], fields=list(_WINDOW)))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))) if lists else np.zeros(1, np.int64)
                flat = pa.concat_arrays(lists) if lists else pa.array([], _WINDOW)
                yield pa.record_batch(
                    [*(batch.column(c).take(pa.array(has + at)) for c in kept), pa.array(digest, pa.binary()), pa.array(joined, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                    names=[*kept, "__text", "__words", "__windows"],
                )
                at += len(texts)

    return run


def best_window(words: list[bytes], starts: list[int], item: list[bytes]) -> tuple[float, int]:
    """(similarity, start) of the most similar window of the item's size, the first of equals; the windows slide over the words once."""
    want = shingles_of(item)
    grams = [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
    have: Counter = Counter()
    both = a = z = 0
    best = (-1.0, 0)
    for s in sorted(set(starts)):
        end = max(s, min(s + len(item), len(words)) - SHINGLE + 1)
        if s >= z:
            have, both, a, z = Counter(), 0, s, s
        for g in grams[a:s]:
            if g in want:
                both -= have[g] <= want[g]
                have[g] -= 1
        for g in grams[z:end]:
            if g in want:
                have[g] += 1
                both += have[g] <= want[g]
        a, z = s, end
        got = both / max(1, (z - a) + want.total() - both)
        if got > best[0]:
            best = (got, s)
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, starts, stretch, item = (batch.column(c).to_pylist() for c in ("first", "starts", "stretch", "words"))
        best = [best_window(w.split(b" "), [s - f for s in ss], i.split(b" ")) for f, ss, w, i in zip(first, starts, stretch, item, strict=True)]
        cols = [batch.column("__text"), batch.column("item"), pa.array([f + s for f, (_, s) in zip(first, best, strict=True)], pa.int64()), pa.array([x for x, _ in best], pa.float64())]
        yield pa.record_batch(cols, names=["__text", "item", "start", "similarity"])


def _itemised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = [], []
        for i, t in enumerate(batch.column(1)):
            w = words_of((t.as_py() or "").encode())
            if len(w) >= SHINGLE:
                joined = b" ".join(w)
                h, _ = shingle_hashes(*word_hashes([joined]), SHINGLE)
                ids.append(i)
                rows.append((hashlib.md5(joined).digest(), joined, len(w), simhash(h), np.unique(h).view(np.int64)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.record_batch([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["item_id", "item", "words", "size", "item_fp", "hashes"])


def _keys(fp: Column, cuts: list[tuple[int, int]]) -> Column:
    """(number, bits) of each block of a fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)).alias("v")) for i, (a, n) in enumerate(cuts)])


def _met(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Windows (size, fp and others) with the items of their size within the radius, by equal blocks."""
    cuts = blocks(radius)
    items = items.select("item", "size", "item_fp", F.explode(_keys(F.col("item_fp"), cuts)).alias("k"))
    met = windows.select("*", F.explode(_keys(F.col("fp"), cuts)).alias("k")).join(F.broadcast(items), ["size", "k"])  # at most PASS_ITEMS items
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair that agrees in several blocks counts in the first of them
    first = F.lit(len(cuts))
    for i, (a, n) in reversed(list(enumerate(cuts))):
        first = F.when(F.shiftrightunsigned(apart, a).bitwiseAND(F.lit((1 << n) - 1)) == 0, i).otherwise(first)
    return met.where((F.bit_count(apart) <= radius) & (F.col("k.i") == first))


def leaking(docs: DataFrame, benchmark: DataFrame, kept: list[str], radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """The columns ``kept`` (no names that begin with __text, __words, __windows), item_id, start, similarity of each row of ``docs`` and item that its text holds."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", "text").mapInArrow(_itemised, f"item_id {kind}, item binary, words binary, size int, item_fp long, hashes array<long>")
    items = materialise(items, "items")
    ids = items.select("item_id", "item").distinct()
    texts = materialise(items.drop("item_id").dropDuplicates(["item"]), "item_texts")
    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    passes = max(-(-total["n"] // PASS_ITEMS), -(-total["words"] // PASS_WORDS), 1)
    row = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)
    done = None
    for p in range(passes):
        part = texts.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        pairs = part.select("size", F.explode("hashes").alias("h")).distinct().toArrow()
        shared = spark.sparkContext.broadcast((pairs.column("h").to_numpy().view(np.uint64), pairs.column("size").to_numpy().astype(np.int64), least))
        sent = [*kept, *([] if "text" in kept else ["text"])]
        found = docs.select(*sent).mapInArrow(_find(shared, kept), f"{row}, __text binary, __words binary, __windows {_WINDOWS}")
        found = materialise(found, "found")
        own = found.groupBy("__text").agg(F.first("__words").alias("__words"), F.first("__windows").alias("w"), F.count("*").alias("n"))
        own = materialise(own, "texts")
        windows = own.select("__text", F.explode("w").alias("x")).select("__text", "x.*")
        pairs = _met(windows, part, radius).groupBy("__text", "item").agg(
            F.collect_list("start").alias("starts"), F.min("start").alias("first"), F.min("begin").alias("begin"), F.max("end").alias("end")  # numbers of one text's words
        )
        cut = F.expr("substring(__words, begin + 1, end - begin)").alias("stretch")
        pairs = pairs.join(own.select("__text", "__words"), "__text").select("__text", "item", "first", "starts", cut)
        # candidates are few; a stage of their own keeps a task at one Python worker
        pairs = pairs.repartition("__text", "item").join(F.broadcast(part.select("item", "words")), "item")
        scored = pairs.mapInArrow(_verify, "__text binary, item binary, start long, similarity double").where(F.col("similarity") >= least)
        scored = materialise(scored, "scored")
        names = scored.join(ids, "item").join(own.select("__text", "n"), "__text").select("__text", "n", "item_id", "start", "similarity")
        n_rows = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        got = join_counted(found.select(*kept, "__text"), materialise(names, "names"), ["__text"], n_rows)
        got = got.select(*kept, "item_id", "start", "similarity")
        done = got if done is None else done.union(got)
        shared.unpersist()
    return done


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start (first word of the best window), similarity for each document and item that it holds.

    docs: doc_id, text; benchmark: item_id, text. Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII
    characters. Null, empty and short texts and items (under five words) have no shingle: they leak nothing and nothing leaks
    from them. Repeated rows give one row, and items of equal words one for each item_id. Rows without a doc_id are reported
    under null. Very long texts and items cost what their words are. Other columns are ignored.
    """
    found = leaking(docs.select("doc_id", "text"), benchmark, ["doc_id"], radius, least)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.s")).alias("start"), "x.similarity")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
