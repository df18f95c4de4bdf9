"""Sums of a stream that are kept by what is new."""

import numpy as np
from pyspark.sql import functions as F

from orbweave.streaming import running as R


def test_a_generation_reads_new_images_only_and_state_survives_a_restart(spark, tmp_path):
    inbox, store, mark = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "mark")
    x = np.random.default_rng(1).normal(0, 1, (90, 5))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def drain():
        source = spark.readStream.schema("image_id long, data array<double>").option("maxFilesPerTrigger", 1).parquet(inbox).mapInArrow(counted, "image_id long, data array<double>")
        before = read.value
        R.run_sums(spark, source, store, mark)
        return read.value - before

    def put(a, b, files):
        spark.createDataFrame([(i, x[i].tolist()) for i in range(a, b)], "image_id long, data array<double>").repartition(files).write.mode("append").parquet(inbox)

    seen = 0
    for a, b, files in ((0, 40, 2), (40, 70, 1), (70, 90, 3)):
        put(a, b, files)
        assert drain() == b - a  # and not b
        seen = b
        got = R.mean_image(R.latest(spark, store)).orderBy("p").collect()
        assert [r["n"] for r in got] == [seen] * 5 and np.allclose([r["v"] for r in got], x[:seen].mean(0))
    assert drain() == 0
    assert R.latest(spark, store).count() <= R.SHARDS
    assert abs(R.latest(spark, store).agg(F.sum("squares")).first()[0] - (x * x).sum()) < 1e-9
