"""Sums over a stream of images that are kept up to date by what is new: a stateful operator over shards of images.

Each shard (a hash of the image's id, so none is larger than others) keeps how many images it has seen, the sum of their values pixel by
pixel, and the sum of squares. A micro-batch reads its own images and the state of their shards, and hands on the shards' new sums; what a
generation needs of all images so far (count, mean image, radial profile, scale) comes from the few rows of the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 64
SUMS = "shard int, n long, total array<double>, squares double"
#: The state store that the operator needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningSums(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("sums", "n long, total array<double>, squares double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's name)
        n, total, squares = 0, 0.0, 0.0
        if self.held.exists():
            n, total, squares = self.held.get()
            total = np.array(total)
        for part in rows:
            x = np.stack(part["data"].to_numpy()).astype(float)
            n, total, squares = n + len(x), total + x.sum(0), squares + float((x * x).sum())
        self.held.update((int(n), total.tolist(), float(squares)))
        yield pd.DataFrame({"shard": [key[0]], "n": [n], "total": [total.tolist()], "squares": [squares]})

    def close(self) -> None:
        """Nothing is open."""


def run_sums(spark: SparkSession, source: DataFrame, store: str, checkpoint: str) -> None:
    """Drains a stream of images (image_id, data) into ``store``: a row for each shard and micro-batch that it had images in, with its sums so far.

    Started again with the same checkpoint it goes on with the state it had. A micro-batch that is sent again replaces its rows.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        shards = source.select(F.pmod(F.xxhash64("image_id"), F.lit(SHARDS)).cast("int").alias("shard"), F.col("data").cast("array<double>").alias("data"))
        sums = shards.groupBy("shard").transformWithStateInPandas(RunningSums(), SUMS, "Update", "None")
        query = (
            sums.writeStream.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{store}/version={number}"))
            .outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)


def latest(spark: SparkSession, store: str) -> DataFrame:
    """shard, n, total, squares: the sums of each shard after its last micro-batch. SHARDS rows at most."""
    rows = spark.read.schema(SUMS + ", version long").parquet(store)
    return rows.groupBy("shard").agg(F.max_by(F.struct("n", "total", "squares"), "version").alias("x")).select("shard", "x.*")


def mean_image(sums: DataFrame) -> DataFrame:
    """p, n, v: the mean of each pixel over all images so far."""
    each = sums.select("n", F.posexplode("total").alias("p", "s")).groupBy("p").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return each.select("p", "n", (F.col("s") / F.col("n")).alias("v"))
