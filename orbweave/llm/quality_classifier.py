"""Operator 5: quality classifier, a support vector machine over naive Bayes features.

A document's features are indicators of hashed byte trigrams, words, word pairs and word repetition. Each indicator is scaled
by the log ratio of its smoothed counts in the two classes, rows are brought to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent.

The fit sees a bounded sample of labelled rows: of the labelled documents outside the held-out third whose texts have at most
FIT_BYTES bytes, the FIT_ROWS with the smallest hash of doc_id. So the sample's bound is FIT_ROWS rows of FIT_BYTES bytes, and it
is full whenever so many such documents exist. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty
from .packing import grouped
from .shingles import SPACE, mix, word_hashes

FIT_ROWS = 4096
FIT_BYTES = 32 << 10
#: Hashed features; the model's size.
BUCKETS = 1 << 18
BIAS = 0
SMOOTH = 1.0
COST = 4.0
EPOCHS = 20
#: Steepness of the score's logistic curve over the margin.
STEEP = 4.0


def held_out(doc_id: Column) -> Column:
    """The third of the documents whose labels are never learnt from (a null doc_id isn't in it)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Features:
    """The distinct features of texts. The table of last occurrences makes distinctness linear in the text."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, dtype=np.int64)

    def _bucket(self, h: np.ndarray, salt: int) -> np.ndarray:
        return (mix(h + np.uint64(salt)) >> np.uint64(64 - 18)).astype(np.int64)

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        raw = [t.encode() for t in texts]
        words, owner = word_hashes(raw, SPACE)
        pairs = np.concatenate((words[:1], words[1:] + (words[:-1] << np.uint64(1))))
        same = np.concatenate((np.zeros(min(1, len(words)), bool), words[1:] == words[:-1]))
        word_at, pair_at = self._bucket(words, 1), self._bucket(pairs, 2)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, b in enumerate(raw):
            x = np.frombuffer(b, dtype=np.uint8).astype(np.uint64)
            a, z = int(cut[i]), int(cut[i + 1])
            tri = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:] if len(x) > 2 else x[:0]
            # how large a share of the words repeat the word before, in powers of two
            share = int(same[a + 1 : z].sum()) / max(1, z - a)
            repeats = np.array([i for i in range(8) if share >= 2.0 ** -(i + 1)], dtype=np.uint64)
            codes = np.concatenate((np.array([BIAS]), self._bucket(tri, 3), word_at[a:z], pair_at[a + 1 : z], self._bucket(repeats, 4)))
            at = np.arange(len(codes))
            self.last[codes] = at
            yield codes[self.last[codes] == at]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Features()
    for batch in batches:
        out = [f.astype("<i4").tobytes() for texts in grouped(t.as_py() for t in batch.column(0)) for f in make.of(texts)]
        yield pa.record_batch([batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["quality", "nth", "features"])


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each feature between the classes of y (1 and -1), with added counts of SMOOTH."""
    p, q = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for f, k in zip(rows, y, strict=True):
        (p if k > 0 else q)[f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights over the scaled features, and the log-count ratios that scale them. Zeros if a class is missing.

    Dual coordinate descent for the hinge loss: each step solves for one row's multiplier exactly, within 0 and COST.
    """
    if len(set(y.tolist())) < 2:
        return np.zeros(2 * BUCKETS, np.float32)
    ratio = log_count_ratios(rows, y)
    ratio[BIAS] = np.abs(ratio).mean()
    w, alpha = np.zeros(BUCKETS), np.zeros(len(rows))
    scaled = [(ratio[f] / np.sqrt((ratio[f] ** 2).sum())).astype(np.float32) for f in rows]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)).tolist():
            f, x = rows[i], scaled[i]
            # rows have unit length, so the second derivative is 1
            new = min(max(alpha[i] - (y[i] * (w[f] @ x) - 1.0), 0.0), COST)
            if new != alpha[i]:
                w[f] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return np.concatenate((w, ratio)).astype(np.float32)


def _fit_group(group: pa.Table) -> pa.Table:
    order = np.argsort(group.column("nth").to_numpy(), kind="stable")
    features = group.column("features")
    rows = [np.frombuffer(features[int(i)].as_py(), dtype="<i4") for i in order]
    y = np.where(group.column("quality").to_numpy()[order] == 1, 1.0, -1.0)
    return pa.table({"model": pa.array([fit(rows, y).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The model of a bounded sample. labels: doc_id, quality; several labels of a document count as the worst of them.

    Labels without a document, and those of longer texts, don't use up the sample. Only ids are shuffled to find it.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = docs.select("doc_id", text_or_empty().alias("text")).where(F.octet_length("text") <= FIT_BYTES)
    ids = sample.select("doc_id").distinct().join(ids, "doc_id")
    ids = ids.withColumn("nth", F.xxhash64("doc_id")).orderBy("nth", "doc_id").limit(FIT_ROWS)
    sample = sample.join(F.broadcast(ids), "doc_id").select("text", F.col("quality").cast("int").alias("quality"), "nth")
    # repeated documents would enlarge the sample
    sample = sample.groupBy("nth", "quality").agg(F.min("text").alias("text")).select("text", "quality", "nth")
    rows = sample.mapInArrow(_featured, "quality int, nth long, features binary")
    model = rows.withColumn("fit", F.lit(1)).groupBy("fit").applyInArrow(_fit_group, "model binary").first()
    return np.frombuffer(model["model"], dtype=np.float32) if model else np.zeros(0, np.float32)


def score(docs: DataFrame, model: np.ndarray, kept: list[str], name: str = "score") -> DataFrame:
    """The columns ``kept`` of ``docs`` and the score (0.5 for all if there is no model)."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = kept if "text" in kept else ["text", *kept]
    model = model if len(model) == 2 * BUCKETS else np.zeros(2 * BUCKETS, np.float32)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*kept).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        w, ratio = shared.value[:BUCKETS].astype(np.float64), shared.value[BUCKETS:].astype(np.float64)
        wr, rr = w * ratio, ratio * ratio
        for batch in batches:
            out = []
            for texts in grouped(t.as_py() or "" for t in batch.column("text")):
                for f in make.of(texts):
                    margin = wr[f].sum() / max(1e-12, np.sqrt(rr[f].sum()))
                    out.append(1 / (1 + np.exp(-STEEP * margin)))
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(out, pa.float64())], names=[*kept, name])

    return docs.select(*sent).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, kept: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``kept`` of every row of ``docs`` (doc_id, text and others), with score (0 to 1) and predicted (0 or 1).

    The two go by ``names``; columns of those names are replaced.

    Null and empty texts have the bias feature alone. Repeated rows get equal scores. Without labels of both classes every
    score is 0.5 and every document is predicted 1.
    """
    model = train(docs, labels)
    kept = [c for c in kept if c not in names]
    return score(docs, model, kept, names[0]).withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, labels, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
