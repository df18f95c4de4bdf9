"""Generations of one micro-batch are one call, whatever their number."""

from orbweave.streaming import generations as S


def test_generations_of_a_micro_batch_run_together(spark, tmp_path):
    for i in range(3):
        spark.range(40 * i, 40 * i + 40, 1, 1).withColumnRenamed("id", "image_id").write.parquet(f"{tmp_path}/source/file={i}")
    calls = []

    def source():
        return spark.readStream.schema("image_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source").select("image_id")

    def take(numbers, images):
        calls.append((numbers.start, numbers.stop, images.count()))

    args = (str(tmp_path / "store"), str(tmp_path / "mark"), 5)
    assert S.run_stream(spark, source(), *args, take, together=True) == 24
    assert calls == [(0, 8, 40), (8, 16, 80), (16, 24, 120)]
    assert S.finished(spark, args[0]) == (24, False)
    assert S.run_stream(spark, source(), *args, take, together=True) == 24 and len(calls) == 3
