"""Operator 11: ranked lexical search with variable block maxima (VBM-WAND).

A map task reads documents once and cuts them into shards of bounded size; within a shard documents have numbers, and each term a
posting list (numbers, occurrences) in their order. Postings aren't shuffled to be built. From the lists come the counts over all
documents (N, L and each term's df) by partial sums, and with them each posting's impact, (1000000000 tf) div (1000 tf + 8 m).

Blocks are cut by dynamic programming: of all ways to cut a list into blocks of up to MAX_BLOCK postings the one is taken that
makes PRICE for each block plus the sum of (largest impact of the block - impact) least. Lists are cut side by side, a step for all.

The search of a shard goes through one query at a time. The block maxima that cover a document number, weighted and summed, bound
the score of that document; numbers whose bound is under the k-th best score so far are skipped, and blocks in which no
number is left are never read. In the blocks that are read the pivot test of WAND sums the maxima of only those lists that hold the
document, and only documents that pass it are scored. The most promising numbers come first, so that the k-th score rises early;
the others follow in chunks of document order. Bounds and scores are 64-bit integers and equal bounds aren't skipped, so results
are exact, ties included.

Queries are cut into groups; a shard's lists go by key to the groups that ask for their terms, so a task holds one shard and
one group, whatever the number of either.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_WORD, UPPER, LOWER, materialise, small_batches, table

K = 10
#: Terms are runs of ASCII letters and digits and of all that isn't ASCII; of UTF-8 bytes these are the same.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Documents of a shard, at most, its postings, at most but for those of one slice more, and documents that are read together.
SHARD_DOCS, SHARD_POSTINGS, SLICE = 8192, 2 << 20, 128
#: Postings of a block, at most, and of the stretch of a list within which cuts are chosen.
MAX_BLOCK, STRETCH = 64, 1024
#: What a block costs, in units of impact (which is under a million).
PRICE = 1_000_000
#: Queries that are searched in one task, at most about.
QUERIES = 512
#: Terms of queries up to this many go to the tasks that read documents; of more, all postings are written and then joined.
BROADCAST_TERMS = 300_000
#: Numbers that are tried first, for a high k-th score, and chunks of the others.
FIRST, CHUNK = 64, 2048

LISTS = "shard long, term binary, docs binary, tfs binary, lengths binary, ids array<long>, n_docs long, n_terms long"


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # of bytes: A-Z only


class _Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = len(self)
        return self[term]


def _lists(wanted: Broadcast | None):
    """Rows of LISTS: one for each term of a shard, and one without a term for its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = {t: i for i, t in enumerate(wanted.value)} if wanted is not None else None
        made = 0
        ids, lengths, held, postings, numbers = [], [], [], 0, _Numbers() if fixed is None else fixed

        def close() -> pa.RecordBatch:
            nonlocal made, ids, lengths, held, postings, numbers
            n = np.concatenate(lengths)
            term, doc, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(term, kind="stable")  # documents come in order
            term, doc, tf = term[order], doc[order].astype("<i4"), tf[order].astype("<i4")
            start = np.flatnonzero(np.diff(term, prepend=-1))
            names = list(numbers)
            part = lambda x: [bytes(y) for y in np.split(x, start[1:])] if len(start) else []
            cols = [
                pa.array([(TaskContext.get().partitionId() << 32) + made] * (len(start) + 1), pa.int64()),
                pa.array([None, *(names[t] for t in term[start])], pa.binary()),
                pa.array([None, *part(doc)], pa.binary()),
                pa.array([None, *part(tf)], pa.binary()),
                pa.array([n.tobytes(), *part(n[doc])], pa.binary()),
                pa.array([ids, *[None] * len(start)], pa.list_(pa.int64())),
                pa.array([int((n > 0).sum()), *np.diff(start, append=len(term)).tolist()], pa.int64()),
                pa.array([int(n.sum(dtype=np.int64)), *[None] * len(start)], pa.int64()),
            ]
            made += 1
            ids, lengths, held, postings, numbers = [], [], [], 0, _Numbers() if fixed is None else fixed
            return pa.record_batch(cols, names=[x.split(" ")[0] for x in LISTS.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                own = b.slice(at, SLICE)
                found = [terms_of(t or b"") for t in own.column(1).to_pylist()]
                n = np.fromiter(map(len, found), dtype="<i4", count=len(found))
                each = itertools.chain.from_iterable(found)
                term = np.fromiter(map(numbers.get, each, itertools.repeat(-1)) if fixed is not None else map(numbers.__getitem__, each), dtype=np.int64, count=int(n.sum(dtype=np.int64)))
                doc = np.repeat(np.arange(len(ids), len(ids) + len(n)), n)
                doc, term = doc[term >= 0], term[term >= 0]
                key, tf = np.unique(doc * max(1, len(numbers)) + term, return_counts=True)
                doc, term = np.divmod(key, max(1, len(numbers)))
                held.append((term, doc, tf))
                postings += len(key)
                ids += own.column(0).to_pylist()
                lengths.append(n)
                if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield close()
        if ids:
            yield close()

    return run


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a posting adds to a score for each unit of its term's weight: tf occurrences in a document of n terms."""
    tf = tf.astype(np.int64)
    m = 10 + (90 * n.astype(np.int64) * docs) // max(1, terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def cut_blocks(lists: list[np.ndarray], price: int = PRICE, most: int = MAX_BLOCK) -> list[np.ndarray]:
    """Of each list of impacts the lengths of its blocks: those that make price x blocks + sum of (block maximum - impact) least, blocks of at most ``most``."""
    size = np.array([len(x) for x in lists], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = np.concatenate([lists[i] for i in order]) if len(lists) else np.zeros(0, dtype=np.int64)
    off = np.cumsum(size) - size
    # for each start of a block that is still open: the largest impact since it, and what was paid before it plus the sum of impacts before it
    top = np.zeros((len(lists), most), dtype=np.int64)
    paid = np.full((len(lists), most), np.iinfo(np.int64).max // 4)
    total = np.zeros(len(lists), dtype=np.int64)
    cost = np.zeros(len(lists), dtype=np.int64)
    back = np.zeros(len(flat), dtype=np.int32)
    for i in range(int(size.max(initial=0))):
        k = int(np.searchsorted(-size, -i, side="left"))  # lists that have an i-th posting
        x, slot = flat[off[:k] + i], i % most
        top[:k, slot], paid[:k, slot] = x, cost[:k] + total[:k] + price
        np.maximum(top[:k], x[:, None], out=top[:k])
        length = (slot - np.arange(most)) % most + 1
        total[:k] += x
        ends = paid[:k] + top[:k] * length
        best = ends.argmin(1)
        cost[:k] = ends[np.arange(k), best] - total[:k]
        back[off[:k] + i] = length[best]
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(lists)
    for at, n, i in zip(off.tolist(), size.tolist(), order.tolist(), strict=True):
        cuts = []
        while n:
            cuts.append(int(back[at + n - 1]))
            n -= cuts[-1]
        out[i] = np.array(cuts[::-1], dtype=np.int64)
    return out


def _cut(docs: int, terms: int):
    """Adds block lengths and maxima to lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tfs, lengths = b.column("tfs").to_pylist(), b.column("lengths").to_pylist()
            stretches, whose = [], []
            for i, (tf, n) in enumerate(zip(tfs, lengths, strict=True)):
                if tf is not None:
                    x = impacts(np.frombuffer(tf, dtype="<i4"), np.frombuffer(n, dtype="<i4"), docs, terms)
                    for a in range(0, len(x), STRETCH):
                        stretches.append(x[a : a + STRETCH])
                        whose.append(i)
            sizes, tops = [[] for _ in tfs], [[] for _ in tfs]
            for i, x, cuts in zip(whose, stretches, cut_blocks(stretches), strict=True):
                sizes[i].append(cuts)
                tops[i].append(np.maximum.reduceat(x, np.cumsum(cuts) - cuts))
            packed = lambda rows: pa.array([np.concatenate(r).astype("<i4").tobytes() if r else None for r in rows], pa.binary())
            is_doc = [t is None for t in tfs]
            n = pa.array([x if d else None for x, d in zip(lengths, is_doc, strict=True)], pa.binary())
            yield pa.record_batch(
                [b.column("shard"), b.column("term"), b.column("docs"), b.column("tfs"), packed(sizes), packed(tops), n, b.column("ids")],
                names=["shard", "term", "docs", "tfs", "blocks", "tops", "lengths", "ids"],
            )

    return run


class Index:
    """(lists, weights, docs, terms): lists by shard and term with their blocks; term and weight; N and L of all documents."""

    def __init__(self, lists: DataFrame, weights: DataFrame, docs: int, terms: int):
        self.lists, self.weights, self.docs, self.terms = lists, weights, docs, terms


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> Index:
    """The index of ``docs`` (doc_id, text); only the lists of ``terms`` (term binary, distinct), if given. Counts are always those of all documents.

    Null texts and texts without a term are documents without a posting. Rows that repeat are documents each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wanted = None
    if terms is not None and terms.count() <= BROADCAST_TERMS:
        wanted = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in terms.collect()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_lists(wanted), LISTS)
    raw = materialise(rows, "postings")
    if terms is not None and wanted is None:
        raw = materialise(raw.join(terms, "term", "left_semi").unionByName(raw.where("term is null")), "postings")
    n = raw.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = n[0] or 0, n[1] or 0
    df = raw.where("term is not null").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = materialise(df.select("term", weight.alias("weight")), "weights")
    schema = "shard long, term binary, docs binary, tfs binary, blocks binary, tops binary, lengths binary, ids array<long>"
    return Index(materialise(raw.mapInArrow(_cut(n_docs, n_terms), schema), "blocks"), weights, n_docs, n_terms)


def search_shard(lists: list[tuple], lengths: np.ndarray, docs: int, terms: int, k: int, rank: np.ndarray, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, scores) of the k best documents of a shard, best first; of equal scores the one that is first by ``rank``.

    lists: (weight, numbers, occurrences, block lengths, block maxima) of each of the query's terms. ``read`` counts (blocks read,
    documents scored).
    """
    n = len(lengths)
    lists = [x for x in lists if x[0] > 0 and len(x[1])]
    if not lists:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    weight = np.array([x[0] for x in lists], dtype=np.int64)
    size = np.array([len(x[1]) for x in lists])
    blocks = np.array([len(x[3]) for x in lists])
    number, tf = np.concatenate([x[1] for x in lists]), np.concatenate([x[2] for x in lists])
    length = np.concatenate([x[3] for x in lists])
    start = np.cumsum(length) - length
    bound = np.concatenate([x[4] for x in lists]) * np.repeat(weight, blocks)
    own = np.repeat(weight, size)
    first, last = number[start], number[start + length - 1]
    # the bound of each number: block maxima that cover it
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, first, bound)
    np.subtract.at(steps, last + 1, bound)
    shallow = np.cumsum(steps)[:n]

    best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))  # numbers, scores
    floor = 1  # a score has to be above 0

    def evaluate(asked: np.ndarray) -> None:
        """asked: numbers in order."""
        nonlocal best, floor
        left = np.zeros(n + 1, dtype=np.int64)
        left[asked + 1] = 1
        here = left[1:].astype(bool)
        left = np.cumsum(left)
        live = left[last + 1] > left[first]  # blocks with a number that is asked for
        some = np.flatnonzero(live)
        size_ = length[some]
        at = np.arange(size_.sum()) - np.repeat(np.cumsum(size_) - size_, size_) + np.repeat(start[some], size_)
        of = np.repeat(some, size_)
        on = here[number[at]]
        at, of = at[on], of[on]
        pivot = np.zeros(n, dtype=np.int64)
        np.add.at(pivot, number[at], bound[of])
        passed = pivot >= floor
        at = at[passed[number[at]]]
        score = np.zeros(n, dtype=np.int64)
        np.add.at(score, number[at], own[at] * impacts(tf[at], lengths[number[at]], docs, terms))
        new = asked[passed[asked] & (score[asked] >= floor)]
        both, s = np.concatenate([best[0], new]), np.concatenate([best[1], score[new]])
        order = np.lexsort((rank[both], -s))[:k]
        best = both[order], s[order]
        if len(order) == k:
            floor = int(best[1][-1])
        if read is not None:
            read.append((len(some), int(passed[asked].sum())))

    todo = np.flatnonzero(shallow >= floor)
    if len(todo) > FIRST:
        top = np.argpartition(-shallow[todo], FIRST - 1)[:FIRST]
        evaluate(np.sort(todo[top]))
        todo = np.delete(todo, top)
    while len(todo := todo[shallow[todo] >= floor]):
        evaluate(todo[:CHUNK])
        todo = todo[CHUNK:]
    return best


def _search(docs: int, terms: int, k: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head = next(r for r in rows if r["term"] is None)
        lengths = np.frombuffer(head["lengths"], dtype="<i4")
        ids = np.array([-(2**63) if x is None else x for x in head["ids"]], dtype=np.int64)
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        asked: dict[int, list] = {}
        for r in (r for r in rows if r["term"] is not None):
            kinds = (("docs", "<i4"), ("tfs", "<i4"), ("blocks", "<i4"), ("tops", "<i4"))
            one = (r["weight"], *(np.frombuffer(r[x], dtype=t).astype(np.int64) for x, t in kinds))
            for q in r["queries"]:
                asked.setdefault(q, []).append(one)
        out = []
        for q, lists in asked.items():
            number, score = search_shard(lists, lengths, docs, terms, k, rank)
            out += [(q, head["ids"][i], s) for i, s in zip(number.tolist(), score.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query", "doc_id", "score"])

    return run


def query_terms(items: DataFrame) -> DataFrame:
    """query (a number of its own for each different item_id and text), item_id, terms (distinct)."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ALNUM_WORD), F.lit(0)))
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).distinct().select("item_id", found.alias("terms"))
    return materialise(rows.where(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id()), "queries")


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """query, doc_id, score: the k best documents of each shard for each query (rows of ``query_terms``) with a score above 0."""
    groups = max(1, -(-queries.count() // QUERIES))
    each = queries.select("query", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("part"), F.explode("terms").alias("term"))
    each = each.withColumn("term", F.col("term").cast("binary")).groupBy("term", "part").agg(F.collect_list("query").alias("queries"))
    each = each.join(index.weights.where("weight > 0"), "term")
    lists = index.lists.where("term is not null").drop("ids", "lengths").join(each, "term")
    none = lambda kind: F.lit(None).cast(kind)
    lists = lists.select("shard", "part", "term", "weight", "queries", "docs", "tfs", "blocks", "tops", none("binary").alias("lengths"), none("array<long>").alias("ids"))
    heads = index.lists.where("term is null").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "term", none("long").alias("weight"), none("array<long>").alias("queries"),
        "docs", "tfs", "blocks", "tops", "lengths", "ids",
    )
    met = lists.unionByName(heads).groupBy("shard", "part")
    return met.applyInArrow(_search(index.docs, index.terms, k), "query long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item, equal scores by ascending doc_id (null first).

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null and empty texts, of either, have no terms: such
    documents are never found, and such items find none. Rows that repeat are documents each, with ranks of their own; equal items are
    one, and items of one item_id with different texts have ranks of their own. A very long text is one document of a shard. Empty
    tables give no rows.
    """
    queries = query_terms(items)
    terms = queries.select(F.explode("terms").alias("term")).distinct().select(F.col("term").cast("binary").alias("term"))
    found = search(build_index(docs, terms), queries, k)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    top = found.withColumn("rank", nth).where(F.col("rank") <= k)
    return top.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op11_ranked_search": f"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
total as (select count(*) filter (len(w) > 0) as docs, sum(len(w))::bigint as terms from d),
tf as (select r, doc_id, len(w)::bigint as n, t, count(*)::bigint as tf from (select r, doc_id, w, unnest(w) as t from d) group by all),
w as (select t, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1)))::bigint as w from tf, total group by t, docs),
q as (select distinct item_id, text, unnest({_TERMS}) as t from benchmark),
s as (
  select item_id, text, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
  from q join tf using (t) join w using (t), total group by all)
select item_id, (row_number() over (partition by item_id, text order by score desc, doc_id))::int as rank, doc_id, score
from s where score > 0 qualify row_number() over (partition by item_id, text order by score desc, doc_id) <= {K}
"""
}
