"""From documents to training sequences: quality, near duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm import stages
from orbweave.llm.common import materialise, table

STAGES = [
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("decontaminate", stages.decontaminate),
    ("redact", stages.redact),
    ("pack", stages.pack),
]

#: SQL can express none of the model-based stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the table that the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
