"""Operator 13: the trie of conversations' common prefixes, summed along heavy paths.

A turn is known by two 64-bit hashes of its role and text. A sequence of turns is known by the exclusive or of hashes of (place,
turn), which is associative, so prefixes are running aggregates (``running``) whatever the length of a conversation; two
different sequences would be taken for one with a chance of 2^-128. Rows are numbered by a range exchange: sorted by conversation
and turn over all partitions, with the counts of what lies in partitions before, so one conversation may hold any share of rows.

Nodes are the distinct (depth, prefix), counted by partial sums. Of a node's children the one with most members (of equals the one
with the smallest member) is heavy; heavy edges make paths. A light child has at most half of its parent's members, so on the way
from any node to the root lie at most log2(conversations) light edges.

Paths are found from chains: while the smallest member stays the same from parent to child and the edge is heavy, nodes lie on one
segment of a conversation, which a running maximum numbers; segments of one path are joined by pointer doubling. Sums over
subtrees then take three steps: each path's own total; rounds in which the paths without an open light path below them hand their totals
to the node that they hang on, each round one level of light edges, so there are logarithmically many; and suffix sums along
each path over the values of its nodes and of what hangs on them.

A node may be the end of a third of all conversations. Their list is sorted by a range exchange and joined to strings piece by
piece, and only these pieces go through SHA-256 in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, join_counted, materialise, table
from .running import BLOCK, running

#: Conversations of so many consecutive ids begin with turns of the first of them, and their number of such turns is below HEADS.
FAMILY, HEADS = 20, 4
#: Repeated rows are told apart by so many numbers when rows are sorted into partitions.
SALT = 64
KEY = ["depth", "k1", "k2"]
NODE = ["conv_id", "depth"]


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): conv_id, pos (from 1), a, b (hashes of the turn), words of every turn in order; conv_id, len."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), (F.monotonically_increasing_id() % SALT).alias("salt")
    )
    order = ["conv_id", "turn", "role", "text", "salt"]
    rows = rows.repartitionByRange(_tasks(spark), *order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(13), "role").alias("b"),
        F.regexp_count("text", F.lit(SPACE_WORD)).cast("long").alias("words"),
    )
    # the id's upper part is the partition, so the parts of a conversation follow one another by it
    rows = materialise(rows.withColumn("part", F.shiftright("at", 33).cast("int")), "turns")
    parts = materialise(rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "parts")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    turns = rows.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "part", "a", "b", "words")
    return turns, parts


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): conv_id, depth (from 1), a, b, words, total of every turn of every rebuilt conversation; conv_id, total."""
    turns, parts = numbered_turns(conversations)
    lengths = parts.groupBy("conv_id").agg(F.sum("n").alias("len"))
    own = lengths.select("conv_id", "len", F.expr(f"conv_id - conv_id % {FAMILY}").alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    bases = lengths.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    own = own.join(bases, "base", "left").withColumn("heads", F.least("h", F.coalesce("base_len", F.lit(0))))
    own = materialise(own.select("conv_id", "base", "h", "heads", (F.col("heads") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total")), "rebuilt")
    # a conversation of many rows has them in several partitions, and meets its facts in each of them
    facts = parts.select("conv_id", "part").join(own.drop("base"), "conv_id")
    placed = materialise(turns.join(facts, ["conv_id", "part"]).drop("part"), "placed")
    tails = placed.where("pos > h").select("conv_id", (F.col("heads") + F.col("pos") - F.col("h")).alias("depth"), "a", "b", "words", "total")
    first = placed.where(f"conv_id % {FAMILY} = 0 and pos < {HEADS}").select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    heads = own.where("heads > 0").select("conv_id", "base", "heads", "total").join(first, "base").where("pos <= heads")
    return tails.unionByName(heads.select("conv_id", F.col("pos").alias("depth"), "a", "b", "words", "total")), own.select("conv_id", "total")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id): one string for each run of a key within a batch."""
    for b in batches:
        keys = np.column_stack([b.column(i).to_numpy() for i in range(3)])
        ids = b.column(3)
        start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, dtype=np.int64)
        text = [",".join(map(str, x.tolist())) for x in np.split(ids.to_numpy(), start[1:])] if len(start) else []
        yield pa.record_batch([*(b.column(i).take(pa.array(start)) for i in range(3)), ids.take(pa.array(start)), pa.array(text, pa.string())], names=[*KEY, "first", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces: the SHA-256 of each key's pieces, joined by commas."""
    key, state = None, None
    for b in batches:
        out = []
        for *at, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if at != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])
    if key is not None:
        yield pa.record_batch([pa.array([x]) for x in (*key, state.hexdigest())], names=[*KEY, "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 from depth, k1, k2, conv_id."""
    tasks = _tasks(ends.sparkSession)
    order = [*KEY, "conv_id"]
    rows = ends.select(*order).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    pieces = rows.mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, piece string")
    return pieces.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _nodes(conversations: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(nodes, largest depth): conv_id, depth, parent_conv_id, heavy, n_convs, n_children, words, ends_sha256."""
    rows, convs = rebuild(conversations)
    longest = convs.agg(F.max("total")).first()[0] or 0
    rows = materialise(rows.withColumns({"x": F.xxhash64("depth", "a"), "y": F.xxhash64("b", "depth")}).drop("a", "b"), "rows")
    rows = running(rows, ["conv_id"], F.col("depth"), longest, {"k1": (F.col("x"), "xor"), "k2": (F.col("y"), "xor")}, block)
    rows = materialise(rows.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("x")), "p2": F.col("k2").bitwiseXOR(F.col("y"))}).drop("x", "y"), "prefixes")
    zero = {c: F.lit(0).cast("long") for c in KEY}
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").withColumns(zero | {c: F.lit(None).cast("long") for c in ("p1", "p2")} | {"words": zero["depth"]})
    nodes = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("words").alias("words"))
    nodes = materialise(nodes.unionByName(root), "nodes")
    ends = rows.where("depth = total").select(*KEY, "conv_id").unionByName(convs.where("total = 0").withColumns(zero).select(*KEY, "conv_id"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    kids = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"))).alias("most"))
    kids = kids.select(*KEY, "n_children", (-F.col("most.col2")).alias("heavy_id"))
    nodes = nodes.join(kids, KEY, "left").join(_ends(ends), KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))})
    nodes = materialise(nodes, "parents")
    kept = ["conv_id", "n_convs", "n_children", "words", "ends_sha256"]
    below = nodes.where("depth > 0").select(*up, *kept)
    parents = nodes.where("n_children > 0").select(*KEY, F.col("conv_id").alias("parent_conv_id"), "heavy_id", F.col("n_children").alias("n"))
    below = join_counted(below, parents, KEY, nodes.count())
    below = below.select(*kept, (F.col("depth") + 1).alias("depth"), "parent_conv_id", (F.col("conv_id") == F.col("heavy_id")).alias("heavy"))
    top = nodes.where("depth = 0").select(*kept, "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(False).alias("heavy"))
    return materialise(below.unionByName(top), "edges"), longest


def heavy_paths(nodes: DataFrame, longest: int, block: int = BLOCK) -> DataFrame:
    """``nodes`` with path_conv, path_depth: the node that its heavy path begins with."""
    begins = ~F.col("heavy") | (F.col("parent_conv_id") != F.col("conv_id")) | (F.col("depth") == 0)
    rows = running(nodes, ["conv_id"], F.col("depth"), longest, {"seg": (F.when(begins, F.col("depth")), "max")}, block)
    rows = materialise(rows, "segments")
    # segments that go on from a segment of another conversation, with that one
    on = rows.where("heavy and depth = seg").select("conv_id", "seg", F.col("parent_conv_id").alias("up_conv"), (F.col("depth") - 1).alias("at"))
    above = rows.select(F.col("conv_id").alias("up_conv"), F.col("depth").alias("at"), F.col("seg").alias("up_seg"))
    links = materialise(on.join(above, ["up_conv", "at"]).select("conv_id", "seg", "up_conv", "up_seg"), "links")
    while True:
        further = links.select(F.col("conv_id").alias("up_conv"), F.col("seg").alias("up_seg"), F.col("up_conv").alias("far_conv"), F.col("up_seg").alias("far_seg"))
        # a segment goes on in one other at most, so keys are distinct on both sides
        links = links.join(further, ["up_conv", "up_seg"], "left")
        links = materialise(links.select("conv_id", "seg", F.coalesce("far_conv", "up_conv").alias("up_conv"), F.coalesce("far_seg", "up_seg").alias("up_seg"), F.col("far_conv").isNotNull().alias("moved")), "links")
        if not links.where("moved").take(1):
            break
        links = links.drop("moved")
    names = rows.groupBy("conv_id", "seg").agg(F.count("*").alias("n")).join(links, ["conv_id", "seg"], "left")
    names = names.select("conv_id", "seg", "n", F.coalesce("up_conv", "conv_id").alias("path_conv"), F.coalesce("up_seg", "seg").alias("path_depth"))
    return join_counted(rows, materialise(names, "names"), ["conv_id", "seg"], rows.count()).drop("seg")


def subtree_sums(nodes: DataFrame, longest: int, values: list[str], block: int = BLOCK) -> DataFrame:
    """``nodes`` (conv_id, depth, parent_conv_id, heavy, n_children and values) with each value summed over the node's subtree."""
    path = ["path_conv", "path_depth"]
    rows = materialise(heavy_paths(nodes, longest, block), "paths")
    own = rows.groupBy(*path).agg(*[F.sum(v).alias(v) for v in values])
    # what a path hangs on: a node that has light children, whose number is known
    heads = rows.where("depth = path_depth and depth > 0").select(*path, F.col("parent_conv_id").alias("at_conv"), (F.col("depth") - 1).alias("at_depth"))
    hooks = rows.where("n_children > 1").select(F.col("conv_id").alias("at_conv"), F.col("depth").alias("at_depth"), *[F.col(c).alias(f"up_{c}") for c in path], F.col("n_children").alias("n"))
    hung = join_counted(heads, hooks, ["at_conv", "at_depth"], rows.count())
    open_ = materialise(own.join(hung, path, "left"), "open")
    done = None
    while True:
        waiting = open_.where("up_path_conv is not null").select(F.col("up_path_conv").alias("path_conv"), F.col("up_path_depth").alias("path_depth")).distinct()
        step = materialise(open_.join(waiting.withColumn("waits", F.lit(True)), path, "left"), "round")
        ready = step.where("waits is null").drop("waits")
        done = ready if done is None else done.unionByName(ready)
        if not step.where("waits").take(1):
            break
        handed = ready.groupBy(F.col("up_path_conv").alias("path_conv"), F.col("up_path_depth").alias("path_depth")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        rest = step.where("waits").drop("waits").join(handed, path, "left")
        open_ = materialise(rest.withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in values}).drop(*[f"more_{v}" for v in values]), "open")
    light = done.where("at_conv is not null").groupBy(F.col("at_conv").alias("conv_id"), F.col("at_depth").alias("depth")).agg(*[F.sum(v).alias(f"light_{v}") for v in values])
    rows = rows.join(light, NODE, "left").withColumns({v: F.col(v) + F.coalesce(f"light_{v}", F.lit(0)) for v in values}).drop(*[f"light_{v}" for v in values])
    if longest >= block:
        rows = materialise(rows, "hung")
    sums = running(rows.withColumnsRenamed({v: f"own_{v}" for v in values}), path, F.lit(longest) - F.col("depth"), longest, {v: (F.col(f"own_{v}"), "sum") for v in values}, block)
    return sums.drop(*path, *[f"own_{v}" for v in values])


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns with the same number (or null, which comes first) are
    in order of role and text; rows that repeat are turns each. Null roles and texts are empty. Rows without a conv_id belong to no
    conversation. Very long texts are read once, hashed and counted. An empty table has no conversation, so not even a root.
    ``block``: places of a conversation or path that are taken in one task.
    """
    nodes, longest = _nodes(conversations, block)
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    nodes = materialise(nodes.withColumns({"n_leaves": leaf, "saved_tokens": saved}).drop("words"), "values")
    sums = subtree_sums(nodes, longest, ["n_leaves", "saved_tokens"], block)
    return sums.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda z: [ascii(z)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, z: case when z >= 0 then xor(acc, z) else xor(acc >> 1, 3988292384::bigint * (acc & 1)) end), 4294967295::bigint)"""
ORACLE = {
    "op13_prefix_trie": rf"""
with t as (
  select conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
own as (select conv_id, conv_id - conv_id % {FAMILY} as base, list(x order by pos) as xs from t group by all),
h as (select *, ({_CRC} % {HEADS})::int as h from own),
s as (select a.conv_id, list_concat(coalesce(b.xs, [])[1:a.h], a.xs[a.h + 1:]) as s from h a left join own b on b.conv_id = a.base),
m as (select conv_id, len(s) as total, d, s[1:d] as p from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from s)),
n as (
  select d, p, min(conv_id) as conv_id, count(*) as n_convs,
         coalesce(sha256(string_agg(conv_id::varchar, ',' order by conv_id) filter (total = d)), sha256('')) as ends_sha256,
         case when d = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) end as saved
  from m group by d, p),
e as (select c.d, c.p, q.conv_id as parent_conv_id from n c join n q on q.d = c.d - 1 and q.p = c.p[1:c.d - 1]),
k as (select d - 1 as d, p[1:d - 1] as p, count(*) as n_children from n where d > 0 group by all),
u as (
  select x.up as d, x.p[1:x.up] as p, sum(saved) as saved_tokens, count(*) filter (leaf) as n_leaves
  from (select n.p, n.saved, k.p is null as leaf, unnest(range(0, n.d + 1)) as up from n left join k on n.d = k.d and n.p = k.p) x group by all)
select n.conv_id, n.d::bigint as depth, e.parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::bigint as n_children, u.n_leaves,
       u.saved_tokens::bigint as saved_tokens, n.ends_sha256
from n left join e on n.d = e.d and n.p = e.p left join k on n.d = k.d and n.p = k.p join u on n.d = u.d and n.p = u.p
"""
}
