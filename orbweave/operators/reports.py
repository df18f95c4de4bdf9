"""Stage timings out of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGE = r"([A-Za-z][A-Za-z ]*?) in ([0-9]+\.[0-9]+)s"
PART = r"(slice|match|slice_oh|match_oh)=([0-9]+\.[0-9]+)s"


def stage_timings(lines: DataFrame, ranks: int) -> DataFrame:
    """stage, kind, n, longest, shortest, mean, std, per_rank from a column ``value`` of log lines."""
    found = None
    for kind, pattern in (("stage", STAGE), ("part", PART)):
        names = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
        times = F.regexp_extract_all("value", F.lit(pattern), F.lit(2))
        part = lines.select(F.lit(kind).alias("kind"), F.explode(F.arrays_zip(names.alias("n"), times.alias("t"))).alias("x"))
        part = part.select("kind", F.col("x.n").alias("stage"), F.col("x.t").cast("double").alias("t"))
        found = part if found is None else found.union(part)
    return found.groupBy("kind", "stage").agg(
        F.count("*").alias("n"), F.max("t").alias("longest"), F.min("t").alias("shortest"), F.avg("t").alias("mean"),
        F.stddev_pop("t").alias("std"), (F.sum("t") / ranks).alias("per_rank"),
    )
