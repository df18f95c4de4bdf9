"""Operator 1: token counts kept up to date by deltas.

Changes come in batches of inserts, deletes and revised counts. A batch is turned into signed rows: what a document counted so
far is taken back, what it counts now is added. The signed rows are summed by source, language and tokenizer version, and the
totals are the sums over all committed batches.

What a document counted so far is found in the ledger. Each batch's rows lie in as many folders, by a hash of the document, as its own
size asks for: one for a small batch, thousands for a large one; its marker says how many. Compaction folds all committed batches
into a base of net rows, again in folders by its size. So a batch reads the few folders of the base that its own documents fall
into, and the batches since.

A batch is committed by its marker, written last. A batch that is committed already changes nothing; one that was broken off
before its marker is invisible, and running it again overwrites what it left. The same holds for a compaction.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, remote_files, shared_dir, small_batches, table, text_or_empty
from .packing import grouped

KEYS = ["source", "lang", "tokenizer"]
#: Rows of a folder, about, and folders of a batch or base, at most; folders of more rows are written by several tasks.
FOLDER_ROWS, MOST_FOLDERS = 1 << 20, 4096
TOKENIZER = "byte_bpe_50k"


def folders_for(rows: int) -> int:
    """A power of two, so that the folders of a small batch are unions of those of a large one."""
    return min(MOST_FOLDERS, 1 << max(0, (max(1, rows) - 1) // FOLDER_ROWS).bit_length())


class TokenLedger:
    """Signed token counts under a folder that all executors share.

    ledger/batch=N/bucket=K: doc_id, source, lang, tokenizer, docs (1 or -1), tokens (signed). totals/batch=N: their sums by source,
    lang and tokenizer. commits/batch=N: the marker, with the number of folders. bases/base=N/ledger, totals and, written last, folded:
    the batches that it holds. The latest whole base counts, and the batches that it doesn't hold.
    """

    LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, batch long, bucket int"
    TOTALS = "source string, lang string, tokenizer string, docs long, tokens long, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self, batch: int) -> bool:
        return remote_files(self.spark, f"{self.path}/commits/batch={batch}/_SUCCESS")

    def _base(self) -> int:
        """The number of the latest base that is whole, or 0."""
        n = 0
        while remote_files(self.spark, f"{self.path}/bases/base={n + 1}/folded/_SUCCESS"):
            n += 1
        return n

    def _live(self) -> tuple[int, int, dict[int, int]]:
        """(base, its folders, folders of each live batch). A row for each batch comes to the driver."""
        base, folders, folded = self._base(), 0, set()
        if base:
            rows = self.spark.read.schema("batch long, folders int").parquet(f"{self.path}/bases/base={base}/folded").collect()
            folders, folded = rows[0]["folders"], {r["batch"] for r in rows}
        live = {}
        if remote_files(self.spark, f"{self.path}/commits"):
            rows = self.spark.read.schema("folders int, batch long").parquet(f"{self.path}/commits").collect()
            live = {r["batch"]: r["folders"] for r in rows if r["batch"] not in folded}
        return base, folders, live

    def _read(self, part: str, schema: str, of: DataFrame | None = None) -> DataFrame:
        """Committed rows of the ledger or the totals; only folders that documents of ``of`` fall into."""
        base, folders, live = self._live()

        def inside(n: int) -> list[int]:
            return sorted(r[0] for r in of.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).distinct().collect())  # at most MOST_FOLDERS

        found = self.spark.createDataFrame([], schema)
        if base:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/bases/base={base}/{part}")
            found = rows.where(F.col("bucket").isin(inside(folders))) if of is not None and folders > 1 else rows
        if live:
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
            wanted = F.lit(False)
            for n in sorted(set(live.values())):
                own = F.col("batch").isin([b for b, k in live.items() if k == n])
                wanted = wanted | (own & F.col("bucket").isin(inside(n)) if of is not None and n > 1 else own)
            rows = rows.where(wanted)
            found = found.unionByName(rows) if base else rows
        return found

    def current(self, of: DataFrame | None = None) -> DataFrame:
        """doc_id, source, lang, tokenizer, tokens of every counted document, or (with others of their folders) of those in ``of``."""
        rows = self._read("ledger", self.LEDGER, of).withColumn("each", F.abs("tokens"))
        net = rows.groupBy("doc_id", *KEYS, "each").agg(F.sum("docs").alias("docs"))
        return net.where("docs > 0").select("doc_id", *KEYS, F.col("each").alias("tokens"))

    def _write(self, rows: DataFrame, folders: int, n: int, path: str) -> None:
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(folders)).cast("int"))
        if folders > 1:
            # a folder of very many rows is written by several tasks
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("tokenizer", "doc_id", "docs"), F.lit(1 + n // (folders * FOLDER_ROWS)))).repartition("bucket", "salt").drop("salt")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)

    def _mark(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commits a batch, unless it is committed already (then False).

        changes: op (insert, revise or delete), doc_id, tokenizer, source, lang, tokens and seq. Of several changes of one
        document and tokenizer in a batch the one with the highest seq counts (then op and the other columns, so that the
        result is the same each time). Inserting a counted document revises it; revising one that isn't counted inserts it;
        deleting one that isn't counted does nothing. Rows without doc_id or tokenizer can't be taken back later and are
        left out; a null count is 0, and negative counts are 0; null source and lang are groups of their own.
        """
        if self.committed(batch):
            return False
        known = changes.where("doc_id is not null and tokenizer is not null and op in ('insert', 'revise', 'delete')")
        tokens = F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0)).alias("tokens")
        last = known.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("seq", "op", tokens, "source", "lang")).alias("x"))
        new = materialise(last.select("doc_id", "x.source", "x.lang", "tokenizer", "x.op", "x.tokens"), "changes")
        plus = new.where("op != 'delete'").select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), "tokens")
        old = self.current(new).join(new.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
        minus = old.select("doc_id", *KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))
        # a batch that changes a document to what it was nets out in the sums
        n = new.count()
        folders = folders_for(n)
        self._write(plus.union(minus), folders, 2 * n, f"{self.path}/ledger/batch={batch}")
        written = self.spark.read.schema(self.LEDGER).parquet(f"{self.path}/ledger/batch={batch}")
        sums = written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self._mark(sums, f"{self.path}/totals/batch={batch}")
        self._mark(self.spark.range(1).select(F.lit(folders).alias("folders")), f"{self.path}/commits/batch={batch}")
        return True

    def compact(self) -> int:
        """Folds all committed batches into a new base, and returns its number (0 if there is nothing to fold). Batches stay known, so none is applied again."""
        base, folders, live = self._live()
        if not live:
            return base
        path = f"{self.path}/bases/base={base + 1}"
        n = self.totals().agg(F.sum("n_docs")).first()[0] or 0
        held = folders_for(n)
        self._write(self.current().withColumn("docs", F.lit(1).cast("long")).select("doc_id", *KEYS, "docs", "tokens"), held, n, f"{path}/ledger")
        sums = self._read("totals", self.TOTALS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self._mark(sums, f"{path}/totals")
        folded = self.spark.read.parquet(f"{self.path}/bases/base={base}/folded").select("batch") if base else self.spark.createDataFrame([], "batch long")
        folded = folded.union(self.spark.createDataFrame([(b,) for b in live], "batch long"))
        self._mark(folded.select("batch", F.lit(held).alias("folders")), f"{path}/folded")
        return base + 1

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; groups without a document are left out."""
        rows = self._read("totals", self.TOTALS).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return rows.where("n_docs != 0")


def count_tokens(docs: DataFrame, kept: list[str], path: str | None = None) -> DataFrame:
    """The columns ``kept`` of every row of ``docs`` and n_tokens: the byte-level BPE tokens of the whole text (null and empty: 0)."""
    small_batches(docs.sparkSession)
    schema = docs.select(*kept).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(f"{TOKENIZER}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) for texts in grouped(t.as_py() for t in batch.column(0)) for t in texts]
            yield pa.record_batch([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*kept, "n_tokens"])

    return docs.select(text_or_empty().alias("__text"), *kept).mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document arrives with an estimate of a token per four bytes and is revised to its exact count. Those that repeat the
    text of a document with a smaller doc_id are deleted and inserted again; then the revision is sent once more, which changes
    nothing. So the totals are those of all documents.

    A document is known by its doc_id; rows without one by their source, language and text. Repeated rows of either count once.
    Of rows with one doc_id and different contents, that with the largest count stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    docs = docs.withColumn("estimate", F.ceil(F.octet_length(text_or_empty()) / 4)).withColumn("digest", F.sha2(text_or_empty(), 256))
    counted = materialise(count_tokens(docs, ["doc_id", "source", "lang", "estimate", "digest"]), "counted")
    unnamed = F.col("doc_id").isNull()
    counted = counted.withColumns({"unnamed": unnamed, "doc_id": F.coalesce("doc_id", F.xxhash64("source", "lang", "digest"))})
    first = counted.groupBy("digest").agg(F.min(F.struct("unnamed", "doc_id"))["doc_id"].alias("doc_id"))
    copies = counted.join(first, "doc_id", "left_anti")
    ledger = TokenLedger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")

    def batch(n: int, op: str, rows: DataFrame, tokens: str) -> None:
        ledger.apply(n, rows.select(F.lit(op).alias("op"), "doc_id", F.lit(TOKENIZER).alias("tokenizer"), "source", "lang", F.col(tokens).alias("tokens"), F.lit(n).alias("seq")))

    batch(1, "insert", counted, "estimate")
    batch(2, "revise", counted, "n_tokens")
    batch(3, "delete", copies, "n_tokens")
    batch(4, "insert", copies, "n_tokens")
    batch(2, "revise", counted, "n_tokens")
    return ledger.totals()
