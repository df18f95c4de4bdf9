"""Count-triggered generations over an ordered stream of events.

A generation runs each time another ``size`` events are in. It sees all events so far, up to a cap; once the cap is reached
every further event triggers one on the same data. State lives in tables: the images, which generations have ended, and their
results, so a restart goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ranked


def assign(events: DataFrame, size: int, order: str = "event_id") -> DataFrame:
    """events with their generation, by count."""
    return ranked(events, order).withColumn("generation", F.floor(F.col("rank") / size)).drop("rank")


def cumulative_mean(events: DataFrame, size: int, order: str = "event_id") -> DataFrame:
    """generation, n, mean over all events up to and with each generation."""
    per = assign(events, size, order).groupBy("generation").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    per = ranked(per, "generation", totals={"n_seen": "n", "sum_seen": "total"})
    return per.select("generation", F.col("n_seen").alias("n"), (F.col("sum_seen") / F.col("n_seen")).alias("mean"))


def capped(events: DataFrame, size: int, cap: int, generations: int, order: str = "event_id") -> DataFrame:
    """generation, last_rank, n_seen: which event triggers each generation and how many are seen by it."""
    full = cap // size
    at = ranked(events, order).select("rank")
    by_count = at.where((F.col("rank") < cap) & ((F.col("rank") + 1) % size == 0)).select((F.floor((F.col("rank") + 1) / size) - 1).alias("generation"), F.col("rank").alias("last_rank"))
    extra = at.where((F.col("rank") >= cap) & (F.col("rank") < cap + generations - full)).select((F.col("rank") - cap + full).alias("generation"), F.col("rank").alias("last_rank"))
    every = by_count.union(extra).where(F.col("generation") < generations)
    return every.select("generation", "last_rank", F.least(F.col("last_rank") + 1, F.lit(cap)).alias("n_seen"))


def route(events: DataFrame, workers: int, order: str = "event_id") -> DataFrame:
    """events with the worker that gets them in turn, from 1."""
    return ranked(events, order).withColumn("worker", F.col("rank") % workers + 1).drop("rank")


def fill(events: DataFrame, workers: int, most: int, order: str = "event_id") -> DataFrame:
    """events with the worker that gets them in turn, until each worker has ``most``; further events are left out."""
    routed = ranked(events, order).where(F.col("rank") < workers * most)
    return routed.withColumn("worker", F.col("rank") % workers + 1).withColumn("slot", F.floor(F.col("rank") / workers)).drop("rank")


def pad(events: DataFrame, size: int, order: str = "event_id") -> DataFrame:
    """events by batches of ``size`` (batch, slot), the last batch filled up by repeating the last event. No events give none."""
    rows = ranked(events, order)
    last = rows.orderBy(F.col("rank").desc()).limit(1)
    copies = F.expr(f"sequence(rank + 1, rank + pmod(-(rank + 1), {size}))")
    more = last.where(f"(rank + 1) % {size} != 0").withColumn("rank", F.explode(copies))
    return rows.unionByName(more).withColumns({"batch": F.floor(F.col("rank") / size), "slot": F.col("rank") % size}).drop("rank")


def triggered(n: int, size: int, cap: int | None = None, generations: int | None = None) -> int:
    """Generations that n events trigger: one each ``size``; past the cap one each event, if ``generations`` says where that ends."""
    full = n // size if cap is None or n < cap else cap // size + (n - cap if generations is not None else 0)
    return full if generations is None else min(full, generations)


def stored(spark: SparkSession, store: str, cap: int | None = None) -> DataFrame | None:
    """The images that a stream has stored so far, up to ``cap`` of them by image_id; None before the first."""
    if not _exists(spark, f"{store}/images"):
        return None
    if cap is not None and _exists(spark, f"{store}/capped/_SUCCESS"):
        return spark.read.parquet(f"{store}/capped")
    return spark.read.parquet(f"{store}/images").drop("batch")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def finished(spark: SparkSession, store: str) -> tuple[int, bool]:
    """(generations that a stream has finished, whether the last one ended it)."""
    if not _exists(spark, f"{store}/generations"):
        return 0, False
    last = spark.read.schema("ended boolean, number int").parquet(f"{store}/generations").agg(F.count("*").alias("n"), F.max("ended").alias("ended")).first()
    return last["n"], bool(last["ended"])


def run_stream(
    spark: SparkSession, source: DataFrame, store: str, checkpoint: str, size: int, generation: Callable[[int, DataFrame], bool | None] | Callable[[range, DataFrame], bool | None],
    cap: int | None = None, generations: int | None = None, together: bool = False,
) -> int:
    """Appends a stream's micro-batches to ``store`` and calls ``generation(number, images so far)`` as often as ``triggered`` says.

    Ends when the source is drained. After a generation returns True (converged) further images are stored, but none is run.
    Returns the number of generations run, over all starts.

    together: generations that the same micro-batch triggers see the same images and are one call, ``generation(range of numbers, images so far)``,
    so calls and jobs are as many as micro-batches.

    store/images/batch=N: the images; a micro-batch that is sent again replaces itself, so none is counted twice.
    store/generations/number=N: written once a generation has ended, a row for it (and for those that ran together with it). A stream that is started again goes on after the last of them;
    a generation that was broken off runs again. store/capped: the first ``cap`` images, written once there are more.
    """
    if size < 1 or (cap is not None and (cap < size or cap % size)):
        raise ValueError("a generation takes at least one image, and the cap has to be a multiple of what it takes")
    n, ended = finished(spark, store)
    state = {"n": n, "ended": ended, "counts": {}}
    if _exists(spark, f"{store}/images"):
        counts = spark.read.parquet(f"{store}/images").groupBy("batch").count().collect()  # a row for each micro-batch
        state["counts"] = {r["batch"]: r["count"] for r in counts}

    def take(batch: DataFrame, number: int) -> None:
        path = f"{store}/images/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        state["counts"][number] = spark.read.parquet(path).count()
        total = sum(state["counts"].values())
        if cap is not None and total > cap and not _exists(spark, f"{store}/capped/_SUCCESS"):
            images = spark.read.parquet(f"{store}/images").drop("batch")
            ranked(images, "image_id").where(F.col("rank") < cap).drop("rank").write.mode("overwrite").parquet(f"{store}/capped")
        while state["n"] < (upto := triggered(total, size, cap, generations)) and not state["ended"]:
            first, after = state["n"], upto if together else state["n"] + 1
            state["ended"] = bool(generation(range(first, after) if together else first, stored(spark, store, cap)))
            spark.range(after - first).select(F.lit(state["ended"]).alias("ended")).write.mode("overwrite").parquet(f"{store}/generations/number={first}")
            state["n"] = after

    query = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state["n"]
