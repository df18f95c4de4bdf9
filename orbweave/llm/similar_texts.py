"""Operator 10 for texts of a given similarity: groups of documents that share 0.8 or more of their five-word shingles.

Candidates come from two sides. The minima of the shingles' hashes under BANDS x ROWS functions agree, one by one, as often as
the similarity says, whatever the edit was (words changed here and there, a passage cut, added or replaced); two texts are linked
if all ROWS minima of a band agree. A pair at 0.8 has one of BANDS such bands but for a chance of (1 - 0.8^5)^48, 5 in a billion;
more similar pairs less. Beside that, scattered edits leave the sets of words close: SimHashes over them, FAMILIES of them, are
linked through the vantage-point trees. What hangs together is a candidate component. Within it the exact similarities decide:
documents are one group if links of 0.8 or more lead from one to the other.

A component of bounded size is closed in one task. A larger one is closed in a fixed number of steps, whatever its members: first
its members are sorted by minima of their hashes, ORDERS times over, and each run of bounded size is closed, which links most of what
is alike. What then falls into several groups is joined on rare shingles: two texts of the least similarity share one of the rarest
fifth, and one more, of each. Only texts that share such a shingle with another group are compared again, in parts that these shingles
hang together, and a part that is still too large by all pairs of its blocks. No pairs of texts are ever rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_KEY, SPACE_WORD, ascii_lower, drop_rows, join_counted, join_spread, keep_rows, let, materialise, row_key, small_batches, text_or_empty, words
from .components import connected_components
from .packing import grouped
from .shingles import SPACE, mix, shingle_hashes, word_hashes
from .simhash_dedup import RADIUS, link

SHINGLE = 5
#: Similarity as a ratio of whole numbers, so that ties are exact.
LEAST = (4, 5)
FAMILIES = 6
#: Minima of a band, and bands: see above.
ROWS, BANDS = 5, 48
#: Shingles of a component that one task closes: 16 MB of hashes.
CLOSED = 2 << 20
#: Orders in which the members of a larger component are closed by runs.
ORDERS = 4

_SEEDS = [(0x632BE59BD9B4E019 * (2 * i + 1)) % (1 << 64) for i in range(64)]
_FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(_SEEDS[1])) | np.uint64(1)


def band_keys(shingle: np.ndarray, owner: np.ndarray, n: int) -> list[list[int]]:
    """For each of n texts a key for each band, equal where all minima of the band are; none for a text without a shingle.

    shingle: hashes of the shingles of all texts in order (repeats don't matter); owner: the index of each one's text.
    """
    has, first = np.unique(owner, return_index=True)
    keys = np.zeros((len(has), BANDS), dtype=np.uint64)
    for band in range(BANDS if len(has) else 0):
        key = np.full(len(has), band, dtype=np.uint64)
        for f in _FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(shingle * f, first))
        keys[:, band] = key
    found: list[list[int]] = [[] for _ in range(n)]
    for i, k in zip(has.tolist(), keys.view(np.int64).tolist(), strict=True):
        found[i] = k
    return found


def prints_of(docs: DataFrame, families: int = FAMILIES) -> DataFrame:
    """doc_id, the row's key, node (a hash of the lower-cased words in order), fps: SimHashes over the document's distinct words, bands: keys of
    its five-word shingles' bands (a text of fewer words has none, as it is only similar to one of the same words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            nodes, prints, bands = [], [], []
            for texts in grouped(t.as_py() or "" for t in batch.column("text")):
                raw = [b" ".join(t.encode().lower().split()) for t in texts]
                nodes += [xxh64_intdigest(t, 42) for t in raw]  # as Spark's xxhash64
                w, owner = word_hashes([t.replace(b"\0", b"\1") for t in raw], SPACE)  # 0 is no white space
                h, whole = shingle_hashes(w, owner, SHINGLE)
                bands += band_keys(h[whole], owner[: len(h)][whole], len(raw))
                cut = np.searchsorted(owner, np.arange(len(raw) + 1))
                for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    own, each = np.unique(w[a:z]), []
                    for seed in _SEEDS[:families]:
                        h = mix(own + np.uint64(seed))
                        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                        each.append(int(np.packbits(bits * 2 > len(h), bitorder="little").view("<i8")[0]))
                    prints.append(each)
            yield pa.record_batch([*batch.columns[:3], pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(prints, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", *ROW_KEY, "node", "fps", "bands"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *row_key(), "text").mapInArrow(run, f"doc_id {kind}, {' long, '.join(ROW_KEY)} long, node long, fps array<long>, bands array<long>")


def _banded(nodes: DataFrame) -> DataFrame:
    """Edges a, b from each node to the smallest one that agrees with it in a band. nodes: node, bands."""
    each = nodes.select("node", F.explode("bands").alias("key"))
    shared = materialise(each.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"), "bands")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_counted(each, shared, ["key"], total).where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))


def node_of(text: Column) -> Column:
    return F.xxhash64(F.concat_ws(" ", words(ascii_lower(text), SPACE_WORD)))


def shingles(text: Column) -> Column:
    """Hashes of the distinct five-word shingles; a text of fewer words has one, of all its words; one without words has none."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= SHINGLE, F.array_distinct(many)).otherwise(few)

    return let(words(ascii_lower(text), SPACE_WORD), of)


def _close(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges from each member to the first member of its group, over links of the least similarity."""
    n = len(nodes)
    size = np.array([len(s) for s in sets])
    start = np.concatenate(([0], np.cumsum(size)))
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable").astype(np.int32)  # at most CLOSED shingles, or one text's
    fresh = np.diff(every[order], prepend=every[order[:1]]) != 0
    dense = np.empty(len(every), dtype=np.int32)
    dense[order] = np.cumsum(fresh, dtype=np.int32)
    held = np.repeat(np.arange(n, dtype=np.int32), size)[order]  # owners by shingle
    first = np.concatenate(([0], np.nonzero(fresh)[0], [len(every)]))
    del every, order, fresh
    alone = np.ones(n, dtype=bool)
    edges = []
    for root in range(n):
        if not alone[root]:
            continue
        alone[root] = False
        todo = [root]
        while todo and alone.any():
            p = todo.pop()
            mine = dense[start[p] : start[p + 1]]
            a, z = first[mine], first[mine + 1]
            at = np.repeat(a - np.concatenate(([0], np.cumsum(z - a)[:-1])), z - a) + np.arange((z - a).sum()) if len(mine) else np.zeros(0, int)
            both = np.bincount(held[at], minlength=n)
            near = alone & (both * LEAST[1] >= LEAST[0] * (size + size[p] - both)) & (both > 0)
            for x in np.nonzero(near)[0].tolist():
                alone[x] = False
                edges.append((int(nodes[x]), int(nodes[root])))
                todo.append(x)
    return edges


def _close_components(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (component, node, shingles) come sorted by component; a component may run over several batches. With ``most``, it is closed in runs of at most so many shingles."""
    comp, nodes, sets, held = None, [], [], 0

    def done() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1 and (edges := _close(np.array(nodes), sets)):
            yield pa.record_batch([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for c, node, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if c != comp or (most and held + len(s) > most):
                yield from done()
                comp, nodes, sets, held = c, [], [], 0
            nodes.append(node)
            sets.append(np.asarray(s.values, dtype=np.int64))
            held += len(s)
    yield from done()


def _closed(members: DataFrame) -> DataFrame:
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("component", "node", "shingles").repartition(parts, "component").sortWithinPartitions("component")
    return rows.mapInArrow(_close_components, "a long, b long")


def _closed_runs(members: DataFrame) -> DataFrame:
    """Edges between members that lie in one run, in any of ORDERS orders by the least of the shingles' hashes. A run may end anywhere: these edges needn't be all."""
    edges = members.sparkSession.createDataFrame([], "a long, b long")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for order in range(ORDERS):
        least = F.array_min(F.transform("shingles", lambda s, o=order: F.xxhash64(s, F.lit(o))))
        rows = members.select("component", least.alias("least"), "node", "shingles")
        rows = rows.repartitionByRange(parts, "component", "least", "node").sortWithinPartitions("component", "least", "node")
        edges = edges.union(rows.select("component", "node", "shingles").mapInArrow(partial(_close_components, most=CLOSED), "a long, b long"))
    return materialise(edges, "runs")


def _apart(live: DataFrame) -> DataFrame:
    """node, part: the members of each component that may be like one of another group, in parts that hold both. live (a table): component, node, root, shingles."""
    total = live.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    each = live.select("component", "node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    held = materialise(each.groupBy("component", "shingle").agg(F.count("*").alias("n")).withColumn("texts", F.col("n")), "held")
    each = join_counted(each, held, ["component", "shingle"], total)
    rarest = F.row_number().over(Window.partitionBy("node").orderBy("texts", "shingle"))  # the shingles of one text
    most = F.col("size") - F.ceil(F.col("size") * LEAST[0] / LEAST[1]) + 1
    rare = each.withColumn("rank", rarest).where(F.col("rank") <= most).where("texts > 1").select("component", "node", "root", "shingle")
    rare = materialise(rare, "rare")
    shared = rare.groupBy("component", "shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("first"), F.count("*").alias("n"))
    shared = materialise(shared.where("low != high").select("component", "shingle", "first", "n"), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    edges = join_counted(rare, shared, ["component", "shingle"], total).select(F.col("node").alias("a"), F.col("first").alias("b"))
    return connected_components(edges).withColumnRenamed("root", "part")


def _close_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges within components too large for a task, all pairs of their blocks of about half as much. sizes: component, n (shingles), members."""
    blocks = sizes.select("component", F.ceil(F.col("n") * 2 / CLOSED).alias("blocks"), F.col("members").alias("n"))
    blocks = materialise(blocks, "blocks")
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = join_counted(members, blocks, ["component"], total).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("own != other")
    cell = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    return _closed(own.select(cell.alias("component"), "node", "shingles"))


def _sizes(members: DataFrame) -> DataFrame:
    return materialise(members.groupBy("component").agg(F.sum(F.size("shingles")).alias("n"), F.count("*").alias("members")), "sizes")


def _close_large(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges within components too large for a task: enough to lead from each member to all of its group. sizes: component, members, n (shingles)."""

    def of(rows: DataFrame, which: DataFrame, what: str) -> DataFrame:
        total = which.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return materialise(join_counted(rows, which, ["component"], total), what)

    members = of(members, sizes.select("component", F.col("members").alias("n")), "large")
    edges = _closed_runs(members)
    members = members.join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = materialise(members, "grouped")
    # a component that is one group needs no more
    open_ = members.groupBy("component").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    live = of(members, materialise(open_.where("low != high").select("component", "n"), "open"), "live")
    parts = materialise(live.join(_apart(live), "node").select(F.col("part").alias("component"), "node", "shingles"), "parts")
    sizes = _sizes(parts)
    large = sizes.where(F.col("n") > CLOSED)
    small = _closed(parts.join(large.select("component"), "component", "left_anti"))
    return edges.union(small).union(_close_blocks(parts, large))


def groups(docs: DataFrame, families: int = FAMILIES) -> DataFrame:
    """doc_id, the row's key, and keeper for every row of ``docs`` (doc_id, text): the row that stands for its group.

    keeper: none (its doc_id is null), doc_id and the key of the group's row with the smallest doc_id, then the smallest key.
    """
    prints = materialise(prints_of(docs, families), "sets")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEY)
    nodes = prints.groupBy("node").agg(F.min(own).alias("least"), F.min("fps").alias("fps"), F.min("bands").alias("bands"), F.count("*").alias("n"))
    nodes = materialise(nodes, "nodes")
    each = materialise(nodes.select("node", F.posexplode("fps").alias("family", "fp")), "families")
    shared = materialise(each.groupBy("family", "fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "shared")
    close = materialise(link(shared.select("family", "fp"), RADIUS), "close")
    equal = join_counted(each, shared.where("n > 1"), ["family", "fp"], each.count()).select(F.col("node").alias("a"), F.col("first").alias("b"))
    first = shared.groupBy("fp").agg(F.min("first").alias("first"))
    ends = materialise(join_spread(close, first.withColumnsRenamed({"fp": "a", "first": "x"}), ["a"]), "ends")
    ends = join_spread(ends, first.withColumnsRenamed({"fp": "b", "first": "y"}), ["b"])
    candidates = materialise(connected_components(equal.union(ends.select("x", "y")).union(_banded(nodes))), "candidates")
    # one document speaks for all of the same words
    members = candidates.join(nodes, "node").select("node", F.col("root").alias("component"), *[F.col(f"least.{k}").alias(k) for k in ROW_KEY])
    members = materialise(members, "members")
    texts = keep_rows(docs.select("text", *row_key()), members.select(*ROW_KEY))
    texts = texts.select(node_of(text_or_empty()).alias("node"), shingles(text_or_empty()).alias("shingles")).dropDuplicates(["node"])
    members = materialise(members.drop(*ROW_KEY).join(texts, "node"), "shingles")
    sizes = _sizes(members)
    large = sizes.where(F.col("n") > CLOSED)
    if large.take(1):
        edges = _closed(members.join(large.select("component"), "component", "left_anti")).union(_close_large(members, large))
    else:
        edges = _closed(members)
    roots = materialise(connected_components(edges), "roots")
    linked = materialise(nodes.join(roots, "node").select("node", "root", "least"), "linked")
    least = materialise(linked.groupBy("root").agg(F.min("least").alias("keeper"), F.count("*").alias("n")), "least")
    moved = join_counted(linked, least, ["root"], linked.count()).select("node", "keeper")
    named = nodes.join(moved, "node", "left").select("node", F.coalesce("keeper", "least").alias("keeper"), "n")
    named = join_counted(prints.select("doc_id", *ROW_KEY, "node"), materialise(named, "named"), ["node"], prints.count())
    return named.select("doc_id", *ROW_KEY, "keeper")


def near_duplicates(docs: DataFrame, families: int = FAMILIES) -> DataFrame:
    """doc_id, component_id for every row of ``docs`` (doc_id, text): the smallest doc_id of its group.

    Texts of the same words in the same order are one group whatever their case and spacing; so are all null, empty and blank
    texts. Null doc_ids don't count as the smallest; a group with none but those has null. Repeated rows stay repeated; other
    columns are ignored; very long texts are compared whole. An empty table gives no rows.
    """
    return groups(docs, families).select("doc_id", F.col("keeper.doc_id").alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their groups, one of each: that with the smallest doc_id (null counts as the largest), then the smallest key.

    A row is known by its doc_id and its text, so one doc_id with several texts loses none of them to another's group; of equal
    rows one is kept.
    """
    keys = groups(docs).groupBy(*ROW_KEY).agg(F.first("keeper").alias("keeper"), F.count("*").alias("n"))
    own = (F.col(ROW_KEY[0]) == F.col(f"keeper.{ROW_KEY[0]}")) & (F.col(ROW_KEY[1]) == F.col(f"keeper.{ROW_KEY[1]}"))
    keys = materialise(keys.select(*ROW_KEY, own.alias("keeps"), "n"), "keys")
    keyed = docs.select("*", *row_key())
    left = drop_rows(keyed, keys.where("not keeps").select(*ROW_KEY))
    repeated = keys.where("keeps and n > 1").select(*ROW_KEY)
    if repeated.take(1):
        left = drop_rows(left, repeated).unionByName(keep_rows(left, repeated).dropDuplicates(ROW_KEY))
    return left.select(*docs.columns)
