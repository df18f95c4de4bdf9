"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words of the licence and decontamination operators: ASCII letters and digits and all of non-ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words split at ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def words(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``, whatever the optimizer later merges."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine, where it may be unset, one of this application's own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/orbweave"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in Arrow batches of at most so many rows, so that a worker's memory stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage is cut, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with over one part in HEAVY of all rows; there are fewer than HEAVY of them, so they can be broadcast.
HEAVY = 1000
#: Parts into which the rows of such a key are dealt.
PARTS = 32


def join_counted(rows: DataFrame, names: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` joined to ``names``, which has each key once and the number ``n`` of its rows; ``total`` is at least their sum.

    The rows of a key that holds many are dealt into PARTS parts, by the partition that they come from, and such a key stands once
    for each part in ``names``; so no key lands in one task. ``names`` is read twice: write it to a table first.
    """
    heavy = F.col("n") * HEAVY > total
    dealt = names.withColumn("__part", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    many = names.where(heavy).select(*on, F.lit(True).alias("__many"))
    part = F.when(F.col("__many"), F.pmod(F.spark_partition_id(), F.lit(PARTS))).otherwise(0)
    rows = rows.join(F.broadcast(many), on, "left").withColumn("__part", part).drop("__many")
    return rows.join(dealt, [*on, "__part"]).drop("__part")


def join_spread(rows: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (a table) joined to ``names``, which has each key once, by ``join_counted``; the rows of each key are counted first."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("n"))
    return join_counted(rows, materialise(names.join(counts, on), "names"), on, rows.count())


#: Keys up to this many (some 30 MB) are broadcast.
BROADCAST_IDS = 1_000_000


def _against(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    keys = materialise(keys.distinct(), "ids")
    small = keys.count() <= BROADCAST_IDS and all(t in ("bigint", "int") for _, t in keys.dtypes)
    return docs.join(F.broadcast(keys) if small else keys, keys.columns, how)


def keep_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a key in ``keys`` (columns of both). While the keys are few, the texts aren't shuffled."""
    return _against(docs, keys, "left_semi")


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a key in ``keys`` (columns of both); rows with a null in it stay."""
    return _against(docs, keys, "left_anti")


#: Names of the columns of a row's key.
ROW_KEY = ["__id_key", "__text_key"]


def row_key(id_col: str = "doc_id", text: Column | None = None) -> list[Column]:
    """A row's key, never null: hashes of its doc_id and of its text. Rows have the same key if both are the same (a null text counts as an empty one)."""
    return [F.xxhash64(id_col).alias(ROW_KEY[0]), F.xxhash64(text_or_empty() if text is None else text).alias(ROW_KEY[1])]


def remote_files(spark: SparkSession, path: str) -> bool:
    """Whether anything is at ``path``, in whatever store Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop))
