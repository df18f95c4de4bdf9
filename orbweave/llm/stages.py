"""The corpus pipeline's stages, each by one of the operators. A stage takes (spark, docs, sf_dir).

All stages take tables with nulls in any column, empty and very long texts, repeated rows and columns of any further names, and
give no rows for an empty table. All but the last return the columns of ``docs``. A row is judged by its text and dropped by its
text (and doc_id), never by its doc_id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, packing, personal_data, quality_classifier, similar_texts
from .common import ROW_KEY, drop_rows, row_key, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are judged by the bias alone; equal texts are judged alike. Without labels of both classes all stay.
    """
    judged = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), docs.columns, ("__score", "__predicted"))
    return judged.where("__predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays.

    Null, empty and blank texts are one group. A null doc_id counts as the largest; on ties the smaller hash of the text stays, and
    of equal rows one.
    """
    return similar_texts.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of the same text. Null, empty and short texts hold none and stay."""
    keyed = docs.select("*", row_key()[1])
    found = decontamination.leaking(keyed, table(spark, sf_dir, "benchmark"), ROW_KEY[1:])
    return drop_rows(keyed, found.select(*ROW_KEY[1:])).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets. Null and empty texts stay as they are; equal texts stay equal."""
    return personal_data.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training, one row for each piece of a document. Every row of ``docs`` is packed, repeated ones as often as they occur; a null or empty text is its closing id."""
    return packing.pack(docs.select("doc_id", "text"))
