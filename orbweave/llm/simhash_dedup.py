"""Operator 10: near duplicates by SimHash, with fingerprints linked through vantage-point trees.

Two fingerprints within RADIUS bits differ in at most RADIUS // 2 bits on one of their two halves, so a tree over each half
needs a search radius of one bit instead of three. From PARTS_FROM fingerprints on there is a tree over each choice of parts
instead: of m parts at most RADIUS differ, so the others agree in full in one choice at least, the search radius is 0, and no
point is copied within a tree; m grows with the number of fingerprints, so that what agrees by chance stays small.

At each level of a tree a vantage point, itself a fingerprint, splits the points by Hamming distance into rings; by the triangle
inequality two points within the search radius lie at most that far apart in distance to the vantage point, so rings that
overlap by the radius put every such pair into a ring together, and all other branches are pruned. Points near a boundary go to
both rings. What reaches a leaf is compared exactly over all 64 bits.

A leaf returns the edges of a spanning star for each of its local components, never all its pairs: a leaf of n fingerprints
gives fewer than n rows, while the components of all leaves together are those of all links. Equal fingerprints are one node.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialise, small_batches, table
from .components import connected_components

RADIUS = 3
SHINGLE = 3
#: Ring width. 3 prunes most for each copy of a point that it makes.
WIDTH = 3
#: From so many fingerprints on, trees over halves, whose copies of a point grow with their depth, make more of them than the fixed number of trees over parts.
PARTS_FROM = 4096
#: What it costs to bring a fingerprint to a leaf, in comparisons within a leaf.
COPY = 200
#: Comparisons that a point meets in the leaves of a tree, about; deeper trees make fewer and copy more.
LEAF = 1500
#: Leaves over this many points are split further, inside their task, by vantage points of their own.
SPLIT = 4096
SEED = 42


def fingerprints_of(text: bytes, shingle: int, xxh) -> np.uint64:
    """A bit is 1 if it is set in over half of the XXH64 values of the text's word shingles (repeats included)."""
    w = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not w:
        return np.uint64(0)
    joined = b" ".join(w)
    if len(w) <= shingle:
        return np.uint64(xxh(joined, SEED))
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - shingle + 1].tolist()
    h = np.array([xxh(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # a very long text stays within bounds
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0]


def fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long). Null and empty texts, and those without a word, have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            fps = np.array([fingerprints_of((t.as_py() or "").encode(), shingle, xxh64_intdigest) for t in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(n: float, radius: int) -> int:
    """Into how many parts n fingerprints are cut: for each choice of ``radius`` of m parts there is a tree over the bits of the others."""
    return min(range(radius + 1, radius + 4), key=lambda m: math.comb(m, radius) * (COPY + n / 2 ** (64 * (m - radius) / m)))


def _trees(n: float, radius: int) -> tuple[list[int], int]:
    """(the bits that each tree looks at, its search radius)."""
    if n < PARTS_FROM:
        return [(1 << 32) - 1, (1 << 32) - 1 << 32], radius // 2
    m = _parts(n, radius)
    edges = [64 * i // m for i in range(m + 1)]
    part = [(1 << z) - (1 << a) for a, z in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(part, m - radius)], 0


def _away(vantage: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(vantage)).bitwiseAND(F.col("bits")))


def _rings(vantage: int, radius: int) -> Column:
    d = _away(vantage)
    k = F.floor(d / WIDTH).cast("int")
    return F.when((d % WIDTH < radius) & (k > 0), F.array(k - 1, k)).otherwise(F.array(k))


def _local_components(fps: np.ndarray, radius: int) -> np.ndarray:
    """For sorted distinct fingerprints, the index of the first member of each one's component over links within the leaf."""
    n = len(fps)
    parent = np.arange(n)
    step = max(1, (1 << 21) // n)
    for i in range(0, n, step):
        near = np.bitwise_count(fps[i : i + step, None] ^ fps[None, i:]) <= radius
        a, b = np.nonzero(near)
        keep = a < b
        a, b = a[keep] + i, b[keep] + i
        while len(a):
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            ra, rb = parent[a], parent[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    return parent


def _leaf_links(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star edges of the leaf's components. A large leaf is split on by vantage points of its own over all 64 bits."""
    todo = [(fps, 0)]
    while todo:
        part, tries = todo.pop()
        if len(part) > SPLIT and tries < 24:
            d = np.bitwise_count(part ^ part[(tries * 7919) % len(part)]).astype(np.int64)
            order = np.sort(d)
            mid = order[len(order) // 2]
            # inner ball and outer shell, both with the band in which the triangle inequality can't tell them apart
            inner, outer = part[d <= mid + radius], part[d > mid]
            if max(len(inner), len(outer)) <= 0.9 * len(part):
                todo += [(inner, 0), (outer, 0)]
            else:
                todo.append((part, tries + 1))
            continue
        root = _local_components(part, radius)
        away = np.nonzero(root != np.arange(len(part)))[0]
        if len(away):
            yield part[away], part[root[away]]


def _link_leaves(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by leaf; a leaf may run over several batches."""
        held_leaf, held = None, []

        def close() -> list[tuple[np.ndarray, np.ndarray]]:
            points = np.unique(np.concatenate(held).view(np.uint64)) if held else []
            return list(_leaf_links(points, radius)) if len(points) > 1 else []

        def edges(made: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if made:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*made, strict=True))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            leaf, fp, made = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            cut = np.nonzero(np.diff(leaf))[0] + 1
            for part in (x for x in zip(np.split(leaf, cut), np.split(fp, cut), strict=True) if len(x[0])):
                if part[0][0] != held_leaf:
                    made += close()
                    held_leaf, held = part[0][0], []
                held.append(part[1])
            yield from edges(made)
        yield from edges(close())

    return run


def link(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b among distinct fingerprints (fp long) whose components are those of all pairs within ``radius`` bits.

    With a column ``family`` only fingerprints of one family are linked.
    """
    family = ["family"] if "family" in nodes.columns else []
    n = nodes.count() / max(1, nodes.select(*family).distinct().count() if family else 1)
    trees, search = _trees(n, radius)
    # of the about 10 distances that occur on a half, a ring of WIDTH + 1 holds half of the points; without overlap it holds a seventh
    depth = max(1, math.ceil(math.log(max(n, 2) / LEAF) / math.log(1 / 0.53 if search else 1 / 0.2))) if n > LEAF else 1
    vantages = [r["fp"] for r in nodes.orderBy(F.xxhash64("fp", F.lit(SEED))).limit(depth).collect()]
    rows = nodes.select("fp", *family, F.explode(F.array(*[F.lit(_signed(t)) for t in trees])).alias("bits"))
    if search:
        rows = rows.select("fp", "bits", F.xxhash64("bits", *family).alias("leaf"))
        for v in vantages:
            rows = rows.select("fp", "bits", "leaf", F.explode(_rings(v, search)).alias("ring"))
            rows = rows.select("fp", "bits", F.xxhash64("leaf", "ring").alias("leaf"))
    else:  # a point has one place in a tree
        rows = rows.select("fp", F.xxhash64("bits", *family, *map(_away, vantages)).alias("leaf"))
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = rows.select("leaf", "fp").repartition(tasks, "leaf").sortWithinPartitions("leaf")
    return leaves.mapInArrow(_link_leaves(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that can be reached over links (null doc_ids don't count: a component with none but
    those has null). Null, empty and blank texts have the fingerprint zero; very long texts are read whole. Repeated rows stay
    repeated; other columns are ignored. An empty table gives no rows.
    """
    prints = materialise(fingerprint(docs, shingle), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = materialise(connected_components(link(nodes.select("fp"), radius)), "roots")
    # only fingerprints with a link need more than their own smallest doc_id
    linked = materialise(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least"), "linked")
    least = materialise(linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n")), "least")
    moved = join_counted(linked, least, ["root"], linked.count()).select("fp", "component")
    named = nodes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "n")
    return join_counted(prints, materialise(named, "named"), ["fp"], prints.count()).select("doc_id", "fp", "component_id")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
