"""Operator 8: shards of near equal bytes by histogram sort.

Documents are ordered by a 64-bit hash of their text, so equal texts lie together. Candidate boundaries (probes) cut the key
space; the exact bytes below each probe are counted across all partitions, and only the intervals that hold a splitter are
probed again, more finely, until each splitter is within tolerance. Then the rows are exchanged once.

Equal texts stay in one shard. A group of copies too large for the tolerance is placed whole first, into the emptiest shard,
and the splitters share out the rest by what each shard has left; at most 2 * shards / tolerance groups can be that large, so
the driver sees a bounded number of them. Only a group that fits no shard (as a third of all rows does) is spread: its rows are
numbered, whatever their doc_ids, and runs of them fill the emptiest shards. Slots are numbered where the one exchange has put the
rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty

SHARDS = 16
#: A shard's bytes may differ from the mean by about this share.
TOLERANCE = 0.01
#: Bits by which each round refines an interval.
BITS = 10
#: Rows that are numbered in one task, about.
RUN = 4096


def size_of(text: Column) -> Column:
    return (F.octet_length(text) + 1).cast("long")


def _splitters(rest: DataFrame, targets: list[float], slack: float) -> list[int]:
    """Keys so that the bytes of rows with a smaller key are within slack of each target, or as near as single keys allow."""
    found: dict[int, int] = {}
    shift, step = 64 - BITS, BITS
    # of each open splitter: the interval it was last seen in, and the bytes below that
    open_: dict[int, tuple[int | None, float]] = {j: (None, 0) for j in range(len(targets))}
    while open_:
        rows = rest
        if shift + step < 64:
            rows = rest.where(F.shiftright("key", shift + step).isin(sorted({p for p, _ in open_.values()})))
        counts = sorted(map(tuple, rows.groupBy(F.shiftright("key", shift).alias("prefix")).agg(F.sum("bytes")).collect()))
        still = {}
        for j, (parent, below) in open_.items():
            found[j] = 1 << 63  # no key is as large
            for p, b in counts:
                if parent is not None and p >> step != parent:
                    continue
                if below + b >= targets[j]:
                    if b > slack and shift:
                        still[j] = (p, below)
                    else:
                        low = targets[j] - below <= below + b - targets[j]
                        found[j] = (p if low else p + 1) << shift
                    break
                below += b
        open_ = still
        shift, step = max(0, shift - BITS), min(BITS, shift)
    return [found[j] for j in range(len(targets))]


def _place(big: list[tuple[int, int, int]], share: float, n_shards: int, tolerance: float) -> tuple[list[float], list[tuple], list[tuple]]:
    """(bytes placed in each shard, whole groups and their shards, spread groups with the ends and shards of their runs) of groups (bytes, key, rows).

    A spread group fills the emptiest shards, one after another, up to their share; what is left over goes row by row to the emptiest.
    """
    load, whole, spread = [0] * n_shards, [], []
    for b, k, n in big:
        least = load.index(min(load))
        if n == 1 or load[least] + b <= share * (1 + tolerance / 2):
            load[least] += b
            whole.append((k, least))
            continue
        size, left, ends, to = b // n, n, [0], []  # equal texts have equal sizes
        for j in sorted(range(n_shards), key=load.__getitem__):
            take = min(left, max(0, int((share - load[j]) // size)))
            if take:
                ends.append(ends[-1] + take)
                to.append(j)
                load[j] += take * size
                left -= take
        for _ in range(left):  # by less than a row each shard is short of its share, so these are few
            least = load.index(min(load))
            ends.append(ends[-1] + 1)
            to.append(least)
            load[least] += size
        spread.append((k, ends[1:], to))
    return load, whole, spread


def _numbered(rows: DataFrame, by: str, what: str) -> DataFrame:
    """``rows``, written as they lie, with __nth: the row's number (from 0) among those of the same value of ``by``.

    Rows are numbered within each written partition, and partitions by what lies before them. by: few values.
    """
    rows = rows.sortWithinPartitions(by).withColumn("__row", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("__part", F.shiftright("__row", 33).cast("int")), what)
    parts = rows.groupBy(by, "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(by, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    # one row for each partition and value in it
    return rows.join(F.broadcast(parts), [by, "__part"]).withColumn("__nth", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")


def shard(docs: DataFrame, n_shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard); columns of those names are replaced.

    docs: doc_id, text and others. A null text counts as empty. Null doc_ids and repeated rows are placed like any other, and any
    number of rows may be the same in all columns: doc_ids play no part. Texts of any length are placed whole; one longer than a
    shard's share fills its shard alone. Equal sizes and keys are no special case. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    keys = materialise(docs.select(F.xxhash64(text).alias("key"), size_of(text).alias("bytes")), "keys")
    groups = materialise(keys.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    share = total / n_shards
    big = sorted(((r["bytes"], r["key"], r["n"]) for r in groups.where(F.col("bytes") > share * tolerance / 2).collect()), reverse=True)
    load, whole, spread = _place(big, share, n_shards, tolerance)
    whole = spark.createDataFrame(whole, "__key long, __placed int")
    apart = spark.createDataFrame(spread, "__key long, __ends array<long>, __to array<int>")
    rest = groups.withColumnRenamed("key", "__key").join(F.broadcast(whole), "__key", "left_anti").join(F.broadcast(apart), "__key", "left_anti").select(F.col("__key").alias("key"), "bytes")
    room = [max(0.0, share - x) for x in load]
    fill = (rest.agg(F.sum("bytes")).first()[0] or 0) / max(1.0, sum(room))
    targets = [x * fill for x in accumulate(room)][:-1]
    splitters = _splitters(rest, targets, share * tolerance / 4) if total else [0] * (n_shards - 1)

    below = F.size(F.filter(F.array(*[F.lit(s) for s in splitters if s < 1 << 63]).cast("array<long>"), lambda s: s <= F.col("__key")))
    rows = docs.drop("shard", "slot").withColumn("__key", F.xxhash64(text))
    placed = rows.join(F.broadcast(apart), "__key", "left_anti") if spread else rows
    placed = placed.join(F.broadcast(whole), "__key", "left").withColumn("__shard", F.coalesce("__placed", below)).drop("__placed")
    if spread:
        laid = _numbered(rows.join(F.broadcast(apart), "__key"), "__key", "spread")
        nth = F.size(F.filter("__ends", lambda e: e <= F.col("__nth")))
        placed = placed.unionByName(laid.withColumn("__shard", F.get("__to", nth)).drop("__nth", "__ends", "__to"))
    placed = placed.drop("__key")
    n_runs = max(8, keys.count() // (n_shards * RUN))
    # rows of a shard go to many tasks by their numbers, so equal rows make no large one
    placed = placed.withColumn("__run", F.pmod(F.monotonically_increasing_id(), F.lit(n_runs)))
    placed = _numbered(placed.repartition("__shard", "__run").drop("__run"), "__shard", "shards")
    kept = [c for c in docs.columns if c not in {"shard", "slot"}]
    return placed.select(*kept, F.col("__shard").alias("shard"), F.col("__nth").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard(table(spark, sf_dir, "documents"))
    text = text_or_empty()
    return sharded.select(
        "doc_id", size_of(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
