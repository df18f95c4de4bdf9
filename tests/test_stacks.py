"""Stacks of images as a data source: ranges, streams that are started again, and writers that fail."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orbweave.sources import mrc
from orbweave.sources import stacks as S


def images(spark, first, last, size=6):
    return spark.range(first, last, 1, 3).select(F.col("id").alias("image_id"), F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (F.col("id") * 10 + i).cast("float")).alias("data"))


def save(spark, path, first, last):
    S.write_stack(images(spark, first, last).withColumn("image_id", F.col("image_id") - first), str(path), last - first, 2, 3, 1.5)


def ids(df):
    return sorted(r["image_id"] for r in df.collect())


def test_a_folder_of_stacks_is_one_table_and_ranges_are_pushed_down(spark, tmp_path):
    for n, (a, b) in enumerate([(0, 7), (7, 8), (8, 20)]):
        save(spark, tmp_path / f"run_{n}.mrc", a, b)
    (tmp_path / "_notes").write_text("not a stack")
    whole = S.read_stacks(spark, str(tmp_path), most=24 * 4)
    assert sorted((r["image_id"], tuple(r["data"])) for r in whole.collect()) == sorted((r["image_id"], tuple(r["data"])) for r in images(spark, 0, 20).collect())
    reader = S.StackReader(str(tmp_path), 24 * 4)
    from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan

    left = list(reader.pushFilters([IsNotNull(("image_id",)), GreaterThanOrEqual(("image_id",), 6), LessThan(("image_id",), 11)]))
    assert len(left) == 1 and sum(p.last - p.first for p in reader.partitions()) == 5 and max(p.last - p.first for p in reader.partitions()) <= 4
    part = whole.where("image_id >= 6 and image_id < 11")
    assert ids(part) == [6, 7, 8, 9, 10] and ids(whole.where("image_id = 19")) == [19] and ids(whole.where("image_id > 99")) == []
    assert "image_id >= 6" not in part._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]  # nothing is left for Spark to filter


def test_other_modes_and_short_files(spark, tmp_path):
    raw = bytearray(mrc.to_bytes(np.zeros((2, 2, 2))))
    raw[12:16] = (1).to_bytes(4, "little")
    (tmp_path / "a.mrc").write_bytes(bytes(raw[:1024]) + np.arange(8, dtype="<i2").tobytes())
    assert [r["data"] for r in S.read_stacks(spark, str(tmp_path / "a.mrc")).orderBy("image_id").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    (tmp_path / "a.mrc").write_bytes(bytes(raw[:1024]) + b"12345")
    with pytest.raises(PySparkException, match="ends before"):
        S.read_stacks(spark, str(tmp_path / "a.mrc")).collect()
    raw[12:16] = (99).to_bytes(4, "little")
    (tmp_path / "a.mrc").write_bytes(bytes(raw))
    with pytest.raises(PySparkException, match="mode 99"):
        S.read_stacks(spark, str(tmp_path / "a.mrc")).collect()


def test_a_stream_goes_on_within_a_file(spark, tmp_path):
    S.register(spark)
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")

    def drain():
        stream = spark.readStream.format(S.NAME).option("bytes", 50).load(str(inbox))
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return ids(spark.read.parquet(out))

    save(spark, inbox / "run_0.mrc", 0, 4)
    save(spark, inbox / "run_1.mrc", 4, 9)
    assert drain() == list(range(9))
    save(spark, inbox / "run_1.mrc", 4, 12)  # the same file has grown
    save(spark, inbox / "run_2.mrc", 12, 15)
    assert drain() == list(range(15)) and drain() == list(range(15))


def test_a_volume_is_written_by_its_planes(spark, tmp_path):
    vol = np.random.default_rng(0).normal(0, 1, (5, 3, 4))
    planes = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(vol)], "image_id long, data array<double>").repartition(4)
    path = str(tmp_path / "v.mrc")
    S.write_stack(planes, path, 5, 3, 4, 2.5, (1.0, 2.0, 3.0))
    with open(path, "rb") as f:
        raw = f.read()
    want = mrc.to_bytes(vol, 2.5, (1.0, 2.0, 3.0))
    assert raw[1024:] == want[1024:] and raw[:76] == want[:76]
    assert np.allclose(np.frombuffer(raw[76:88], "<f4"), np.frombuffer(want[76:88], "<f4")) and np.allclose(np.frombuffer(raw[216:220], "<f4"), np.frombuffer(want[216:220], "<f4"))


@pytest.mark.parametrize("fault", ["task", "missing", "twice", "shape"])
def test_a_failed_write_leaves_the_old_file(spark, tmp_path, fault):
    path = tmp_path / "v.mrc"
    save(spark, path, 0, 5)
    old = path.read_bytes()
    new = images(spark, 0, 5)
    if fault == "task":
        new = new.withColumn("data", F.when(F.col("image_id") == 3, F.array(F.raise_error(F.lit("broken")).cast("float"))).otherwise(F.col("data")))
    if fault == "missing":
        new = new.where("image_id != 2")
    if fault == "twice":
        new = new.union(new.where("image_id = 2"))
    if fault == "shape":
        new = new.withColumn("data", F.slice("data", 1, 4))
    with pytest.raises(PySparkException):
        S.write_stack(new, str(path), 5, 2, 3)
    assert path.read_bytes() == old and os.listdir(tmp_path) == ["v.mrc"]
    assert ids(S.read_stacks(spark, str(path))) == list(range(5))
