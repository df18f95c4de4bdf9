"""A fingerprint has as many copies in the trees, however many fingerprints there are."""

from pyspark.sql import functions as F

from orbweave.llm import simhash_dedup


def test_copies_do_not_grow_with_the_depth_of_the_trees(spark):
    found = []
    for n in (5_000, 60_000):
        edges = simhash_dedup.link(spark.range(n).select(F.xxhash64("id").alias("fp")))
        found.append(edges._jdf.queryExecution().optimizedPlan().toString().count("Generate explode"))
    assert found == [1, 1]
