"""Operator 12: exact top-k search by inner product with a KD-tree for each shard.

A map task cuts the vectors that it reads into shards of bounded size, without a shuffle, and builds a tree over each: median splits
of the widest dimension (ties by vec_id) down to leaves, every node with the tight box of its points. The box gives an upper bound
of the inner product of a query with any point in it: each component takes the side of the box that suits its sign.

A search goes down a tree level by level and keeps, for each query, the nodes whose bound can still beat its kth score; then each
query visits its leaves best bound first, in rounds: the queries that stand before one leaf are compared with it by one matrix
product, and the kth scores that a round leaves behind close leaves and nodes for the rounds after it. A node whose bound only
equals the kth score is open as long as it holds a smaller vec_id than the kth, so ties are exact, and groups of equal vectors
are pruned like others.

The kth score is handed on: a query first searches the shard that it lies in, as that needs no shuffle, and takes its kth score
and vec_id to the other shards. There blocks of queries and shards meet in a grid: a task holds a bounded number of both, goes from
shard to shard with the kth scores so far, and returns only what beats those that a query came with. That is the stated query set
against all rows, in blocks; nothing is broadcast, and nothing but numbers of shards reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

K = 20
#: Components are multiplied by this and rounded down.
SCALE = 64
#: Queries are the rows whose vec_id is divisible by this.
EVERY = 20
#: Vectors of a shard, and values of a shard, at most.
SHARD_ROWS, SHARD_VALUES = 16384, 4 << 20
#: Points of a leaf, at most.
LEAF = 256
#: Shards, and blocks of queries, that meet in one task, about; of few shards fewer, so that there are some tasks.
SIDE, LEAST_GROUPS = 8, 4
#: Components beyond this (far outside any embedding) count as this.
LARGEST = 2**31 - 1
#: A score that is no score, and the vec_id that stands for null (it is the largest, so it loses all ties).
NONE, NO_ID = -(2**63) + 1, 2**63 - 1


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer arrays as 64-bit integers; sums beyond those are held at their ends."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), NONE + 1, NO_ID).astype(np.int64)


class Tree:
    """A KD-tree in heap order: node i has the children 2 i + 1 and 2 i + 2, and all leaves are on the last level."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        """Without boxes the tree is built and ids and points are put in its order; with them they are in it."""
        self.ids, self.points = ids, points
        self.depth = max(0, math.ceil(math.log2(len(ids) / LEAF)))
        edges, level = [], [(0, len(ids))]
        for _ in range(self.depth + 1):
            edges.append(level)
            level = [x for a, b in level for x in ((a, (a + b) // 2), ((a + b) // 2, b))]
        self.leaves, self.edges = edges[-1], edges
        if lo is None:
            lo, hi = self._build()
        self.lo, self.hi = lo, hi
        self.least = np.array([self.ids[a:b].min() for level in edges for a, b in level])

    def _build(self) -> tuple[np.ndarray, np.ndarray]:
        lo, hi, perm = [], [], np.arange(len(self.ids))
        for depth, level in enumerate(self.edges):
            for a, b in level:
                own = self.points[perm[a:b]]
                lo.append(own.min(0))
                hi.append(own.max(0))
                if depth < self.depth and own.shape[1]:
                    widest = int((hi[-1].astype(np.int64) - lo[-1]).argmax())
                    perm[a:b] = perm[a:b][np.lexsort((self.ids[perm[a:b]], own[:, widest]))]
        self.ids, self.points = self.ids[perm], self.points[perm]
        return np.array(lo), np.array(hi)

    def bounds(self, q: np.ndarray, depth: int) -> np.ndarray:
        """The largest inner product that any point in the box of each node of a level can have with each query."""
        own = slice(2**depth - 1, 2 ** (depth + 1) - 1)
        return dots(np.hstack([np.maximum(q, 0), np.minimum(q, 0)]), np.hstack([self.hi[own], self.lo[own]]))


class Best:
    """The k best (score, vec_id) of each query so far, best first."""

    def __init__(self, score: np.ndarray, ids: np.ndarray):
        self.score, self.ids = score, ids

    @classmethod
    def none(cls, n: int, k: int) -> Best:
        return cls(np.full((n, k), NONE, dtype=np.int64), np.full((n, k), NO_ID, dtype=np.int64))

    def beaten(self, rows, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether (score, vec_id) would come in before the kth of these rows."""
        kth, at = self.score[rows, -1], self.ids[rows, -1]
        if score.ndim > 1:
            kth, at = kth[:, None], at[:, None]
        return (score > kth) | ((score == kth) & (ids < at))

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        known = np.unique(rows)
        r = np.concatenate([rows, np.repeat(known, k)])
        s = np.concatenate([score, self.score[known].ravel()])
        i = np.concatenate([ids, self.ids[known].ravel()])
        order = np.lexsort((i, -s, r))
        first = np.searchsorted(r[order], known)
        top = order[(first[:, None] + np.arange(k)).ravel()]
        self.score[known], self.ids[known] = s[top].reshape(-1, k), i[top].reshape(-1, k)


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, best: Best) -> None:
    """Adds the tree's points to the best of the queries. A point with a query's own vec_id isn't a candidate for it."""
    open_ = np.ones((len(q), 1), dtype=bool)
    every = np.arange(len(q))
    for depth in range(tree.depth + 1):
        bound = tree.bounds(q, depth)
        own = tree.least[2**depth - 1 : 2 ** (depth + 1) - 1]
        open_ = (open_ if not depth else np.repeat(open_, 2, axis=1)) & best.beaten(every, bound, own)
        if not open_.any():
            return
    bound = np.where(open_, bound, NONE)
    order = np.argsort(-bound, axis=1, kind="stable")
    rows = every
    for nth in range(len(tree.leaves)):
        leaf = order[rows, nth]
        # bounds fall from round to round and kth scores rise, so a query whose bound is too low is done
        on = bound[rows, leaf] >= np.maximum(best.score[rows, -1], NONE + 1)
        rows, leaf = rows[on], leaf[on]
        if not len(rows):
            return
        visit = best.beaten(rows, bound[rows, leaf], own[leaf])
        by = np.argsort(leaf[visit], kind="stable")
        who, where = rows[visit][by], leaf[visit][by]
        found = []
        for group in np.split(np.arange(len(who)), np.flatnonzero(np.diff(where)) + 1) if len(who) else []:
            a, b = tree.leaves[where[group[0]]]
            r, cand = who[group], tree.ids[a:b]
            score = dots(q[r], tree.points[a:b])
            # a null vec_id is no query's own
            x, y = np.nonzero(best.beaten(r, score, cand) & (ids[r, None] != cand))
            found.append((r[x], score[x, y], cand[y]))
        if found:
            best.add(*(np.concatenate(z) for z in zip(*found, strict=True)))


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 2**15 else "<i8"
    return kind, x.astype(kind).tobytes()


SHARD = "shard long, dim int, n int, kind string, ids binary, points binary, lo binary, hi binary"
BLOCK = "shard long, dim int, n int, kind string, ids binary, points binary, score binary, best binary"
FOUND = "query_id long, sig long, home long, vec_id long, score long"


def _row(schema: str, *values) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.record_batch([pa.array([v], kinds[x.strip().split(" ")[1]]) for v, x in zip(values, schema.split(","), strict=True)], names=names)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    made = 0

    def close(dim: int) -> pa.RecordBatch:
        nonlocal made
        ids, points = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        tree = Tree(ids, points)
        kind, packed = _packed(tree.points)
        made += 1
        return _row(SHARD, (TaskContext.get().partitionId() << 32) + made, dim, len(ids), kind, tree.ids.tobytes(), packed, tree.lo.astype(kind).tobytes(), tree.hi.astype(kind).tobytes())

    for b in batches:
        length = np.diff(b.column(1).offsets.to_numpy())
        ids = b.column(0).fill_null(NO_ID).to_numpy()
        flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(length) - length
        for dim in np.unique(length).tolist():
            own = np.flatnonzero(length == dim)
            x = np.clip(np.floor(flat[start[own][:, None] + np.arange(dim)] * float(SCALE)), -LARGEST, LARGEST).astype(np.int64)
            most = max(1, min(SHARD_ROWS, SHARD_VALUES // max(1, dim)))
            at = 0
            while at < len(own):
                room = most - sum(len(i) for i, _ in held.get(dim, []))
                held.setdefault(dim, []).append((ids[own[at : at + room]], x[at : at + room]))
                at += room
                if at <= len(own) and sum(len(i) for i, _ in held[dim]) == most:
                    yield close(dim)
    for dim in list(held):
        yield close(dim)


def _array(row: dict, name: str, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(row[name], dtype=kind).reshape(-1, width) if width else np.zeros((row["n"], 0), dtype=np.int64)


def _tree(row: dict) -> Tree:
    kind, dim = row["kind"], row["dim"]
    boxes = [np.frombuffer(row[x], dtype=kind).reshape(-1, dim) if dim else np.zeros((2 * LEAF, 0), dtype=np.int64) for x in ("lo", "hi")]
    return Tree(np.frombuffer(row["ids"], dtype="<i8"), _array(row, "points", kind, dim), *boxes)


def _at_home(k: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tree = _tree(row)
                asked = np.flatnonzero((tree.ids % every == 0) & (tree.ids != NO_ID))
                if not len(asked):
                    continue
                # equal rows ask once
                _, first = np.unique(np.column_stack([tree.ids[asked], tree.points[asked]]), axis=0, return_index=True)
                asked = asked[first]
                best = Best.none(len(asked), k)
                search(tree, tree.ids[asked], tree.points[asked], best)
                kind, packed = _packed(tree.points[asked])
                yield _row(BLOCK, row["shard"], row["dim"], len(asked), kind, tree.ids[asked].tobytes(), packed, best.score.tobytes(), best.ids.tobytes())

    return run


def _found(ids: np.ndarray, q: np.ndarray, home: int, best: Best, keep: np.ndarray) -> pa.RecordBatch:
    from xxhash import xxh64_intdigest

    sig = np.array([xxh64_intdigest(x.astype("<i8").tobytes()) for x in q], dtype=np.uint64).view(np.int64)
    r, c = np.nonzero(keep & (best.score != NONE))
    got = [ids[r], sig[r], np.full(len(r), home), best.ids[r, c], best.score[r, c]]
    return pa.record_batch([pa.array(x, pa.int64()) for x in got], names=["query_id", "sig", "home", "vec_id", "score"])


def _block(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, Best]:
    best = Best(*(np.frombuffer(row[x], dtype="<i8").reshape(-1, k).copy() for x in ("score", "best")))
    return np.frombuffer(row["ids"], dtype="<i8"), _array(row, "points", row["kind"], row["dim"]), best


def _home_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, q, best = _block(row, k)
                yield _found(ids, q, row["shard"], best, best.score != NONE)

    return run


def _meet(k: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        trees = [(r["shard"], _tree(r)) for r in sorted((r for r in rows if r["lo"] is not None), key=lambda r: r["shard"])]
        out = []
        for row in (r for r in rows if r["lo"] is None):
            ids, q, best = _block(row, k)
            came = Best.none(len(ids), k)
            # only what comes from here goes back, but it has to beat what the query came with
            held = Best(best.score.copy(), best.ids.copy())
            for name, tree in trees:
                if name != row["shard"]:
                    search(tree, ids, q, held)
            old = Best(best.score, best.ids)
            keep = ~_among(held, old)
            came.score, came.ids = held.score, held.ids
            out.append(_found(ids, q, row["shard"], came, keep))
        return pa.Table.from_batches(out, schema=pa.schema([(n, pa.int64()) for n in ("query_id", "sig", "home", "vec_id", "score")]))

    return run


def _among(new: Best, old: Best) -> np.ndarray:
    """Which entries of ``new`` are entries that ``old`` had. Both are sorted; entries that repeat are matched one to one, as often as ``old`` has them."""
    k = new.score.shape[1]
    out = np.zeros(new.score.shape, dtype=bool)
    at = np.zeros(len(out), dtype=np.int64)
    rows = np.arange(len(out))
    for c in range(k):
        spot = np.minimum(at, k - 1)
        same = (at < k) & (new.score[:, c] == old.score[rows, spot]) & (new.ids[:, c] == old.ids[rows, spot])
        out[:, c] = same
        at += same
    return out


def build_shards(vectors: DataFrame) -> DataFrame:
    """The index: one row for each shard (SHARD), written to the shared folder."""
    valid = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(valid)
    return materialise(rows.mapInArrow(_shards, SHARD), "shards")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by ``every``, the k others with the highest integer inner products.

    vectors: vec_id, embedding (other columns are ignored). Components count as floor(SCALE * x); one beyond LARGEST counts as that,
    and a score beyond 64 bits as the largest or smallest one. Ties go to the smaller vec_id. Vectors that are null or hold a null or
    non-finite component take no part; vectors of other lengths than the query's aren't candidates for it; empty ones score 0 with
    one another. A null vec_id asks nothing, is found as null and loses ties. Rows that repeat are candidates each; rows with the query's
    vec_id are none. A vec_id with several rows asks once for each different vector, each with ranks of its own. A query without
    candidates gives no rows, as does an empty table.
    """
    shards = build_shards(vectors)
    blocks = materialise(shards.mapInArrow(_at_home(k, every), BLOCK), "asked")
    found = blocks.mapInArrow(_home_rows(k), FOUND)
    n = shards.count()
    if n > 1:
        groups = max(math.ceil(n / SIDE), min(n, LEAST_GROUPS))
        own, other = F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
        none = F.lit(None).cast("binary")
        trees = shards.select("*", none.alias("score"), none.alias("best"), own.alias("at"), other.alias("asks"))
        asks = blocks.select("shard", "dim", "n", "kind", "ids", "points", none.alias("lo"), none.alias("hi"), "score", "best", other.alias("at"), own.alias("asks"))
        met = trees.unionByName(asks).groupBy("dim", "at", "asks").applyInArrow(_meet(k), FOUND)
        found = found.union(met)
    # of equal rows in several shards one asks
    query = Window.partitionBy("query_id", "sig")
    found = found.withColumn("first", F.min("home").over(query)).where("home = first")
    ranked = found.withColumn("rank", F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op12_exact_search": f"""
with v as (
  select vec_id, [floor({SCALE} * x::double) for x in embedding] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % {EVERY} = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= {K}
"""
}
