"""Operator 9: cost-balanced packing of token sequences.

A document's tokens (with a closing id) are cut into pieces of at most LIMIT. Pieces are dealt evenly into buckets of bounded
size, whatever the number of partitions they come from, and every bucket is packed by itself: its pieces go, in descending length, to the sequence with the lowest estimated
cost (linear in tokens plus quadratic in a piece's length, as attention stays within a piece) among those with room. A piece
that fits nowhere is cut at the lowest-cost sequence's end. A bucket opens as few sequences as hold its tokens, so that its
padding is less than one sequence.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty

LIMIT = 2048
END_ID = 1
_END = END_ID.to_bytes(4, "little")
#: UTF-8 bytes of text to a bucket, about: some hundred sequences, a few MB of ids.
BUCKET_BYTES = 4 << 20
#: What a piece counts besides its text, so that a bucket holds at most some 65,000 pieces, however short they are.
PIECE_BYTES = 64
#: Estimated cost of n tokens in one piece: n + QUADRATIC * n * n.
QUADRATIC = 1 / 1024
#: Words whose ids a Python worker remembers; then it forgets all and begins anew.
REMEMBERED = 200_000
#: Texts are split here only if all their characters are below this, where the tokenizer's Unicode rules are plain.
PLAIN = 0x180


def _plain_class(kind: str) -> str:
    """The plain characters of a Unicode category, as ranges of a regular expression's class."""
    has = [c for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind]
    runs = [list(g) for _, g in itertools.groupby(has, key=lambda c, n=itertools.count(): c - next(n))]
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


def _byte_level() -> dict[int, str]:
    """For each plain character, the printable characters that stand for its UTF-8 bytes in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in own)
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(table[b] for b in chr(c).encode()) for c in range(PLAIN + 0x200)}


class _Words(dict):
    """A word's ids (unsigned 32-bit, little-endian), worked out when first asked for."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_level()

    def __missing__(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(word.translate(self.letters))]).tobytes()
        self[word] = ids
        return ids


class WordTokenizer:
    """The ids that the tokenizer file gives for whole texts, with the ids of each of its words remembered.

    The tokenizer applies its merges within words only, so a text's ids are its words' ids one after another. Texts with
    characters outside the plain range, control characters or the look of a special token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        letters, numbers = _plain_class("L"), _plain_class("N")
        #: The tokenizer's own split pattern, over the plain range; its branches begin with different characters.
        self.split = re.compile(rf"[{letters}]+|[^\s{letters}{numbers}']+(?:'[^\s{letters}{numbers}]*)?|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|'[^\s{letters}{numbers}]*").findall
        self.odd = re.compile(rf"[^\t\n\r\x20-\x7e\xa1-\xac\xae-{chr(PLAIN - 1)}]|<\|").search
        self.known = _Words(self.whole.model)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get, out = self.known.__getitem__, []
        for t in texts:
            if self.odd(t):
                got = np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                got = b"".join(map(get, self.split(t.lower())))
            out.append(np.frombuffer(got + _END, dtype="<u4"))
        return out


#: Odd, and near 2^64 times the fractions of the golden ratio and of the root of 2: their multiples, and sums of them, are spread
#: evenly over 64 bits. A piece's place is its number in its task times the one plus its task's number times the other.
_STRIDE = 0x9E3779B97F4A7C15
_TASK_STRIDE = 0x6A09E667F3BCC909

_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def grouped(texts: Iterator[str], chars: int = 1 << 18) -> Iterator[list[str]]:
    """Lists of consecutive texts of about so many characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def _pieces(path: str, limit: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, at_task, nth = tokenizer(path), TaskContext.get().partitionId() * _TASK_STRIDE, 0
        kind = "<u2" if tok.whole.get_vocab_size() <= 1 << 16 else "<u4"  # what is shuffled is as narrow as the ids allow
        for batch in batches:
            at = 0
            for texts in grouped(t.as_py() or "" for t in batch.column(1)):
                rows, start, tokens, ids, total, bucket = [], [], [], [], [], []
                for x in tok.ids(texts):
                    for s in range(0, len(x), limit):
                        rows.append(at)
                        start.append(s)
                        tokens.append(min(limit, len(x) - s))
                        ids.append(x[s : s + limit].astype(kind).tobytes())
                        total.append(len(x))
                        nth += 1
                        bucket.append((at_task + nth * _STRIDE) % (1 << 64) * n_buckets >> 64)
                    at += 1
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(tokens, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(bucket, pa.int64())],
                    names=["doc_id", "start", "tokens", "ids", "doc_tokens", "bucket"],
                )

    return run


def assign(lengths: np.ndarray, limit: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, first token in it, tokens, sequence, offset) for pieces in the order given, by descending length."""
    n = -(-int(lengths.sum()) // limit)
    room, cost, out = np.full(n, limit), np.zeros(n), []
    for i, length in enumerate(lengths.tolist()):
        done = 0
        while done < length:
            need = length - done
            fits = np.where(room >= need, cost, np.inf)
            k = int(fits.argmin())
            if fits[k] == np.inf:
                k = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(need, int(room[k]))
            out.append((i, done, take, k, limit - int(room[k])))
            room[k] -= take
            cost[k] += take + QUADRATIC * take * take
            done += take
    return out


def _wide(ids: bytes, tokens: int) -> np.ndarray:
    return np.frombuffer(ids, dtype=f"<u{len(ids) // int(tokens)}").astype("<u4")


def _pack(limit: int):
    def run(table_: pa.Table) -> pa.Table:
        sizes = table_.column("tokens").to_numpy()
        order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], str(table_.column("doc_id")[i]), table_.column("start")[i].as_py()))
        placed = assign(sizes[order], limit)
        rows = pa.array([order[p[0]] for p in placed], pa.int64())
        ids = [_wide(table_.column("ids")[order[i]].as_py(), sizes[order[i]])[a : a + n].tobytes() for i, a, n, _, _ in placed]
        bucket = table_.column("bucket")[0].as_py()
        shift = pa.array([p[1] for p in placed], pa.int64())
        start = pa.chunked_array([np.asarray(table_.column("start").take(rows)) + np.asarray(shift)])
        return pa.table(
            {
                "doc_id": table_.column("doc_id").take(rows),
                "start": start,
                "length": pa.array([p[2] for p in placed], pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "doc_tokens": table_.column("doc_tokens").take(rows),
                "sequence_id": pa.array([(bucket << 20) | p[3] for p in placed], pa.int64()),
                "offset": pa.array([p[4] for p in placed], pa.int64()),
            }
        )

    return run


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    docs: doc_id, text. A null or empty text is a document of the closing id alone. Repeated rows are packed as often as they
    occur. An empty table gives no rows. No id is dropped: a document's pieces cover it from 0 to doc_tokens.

    Pieces are dealt to buckets by their numbers, so no key makes a bucket large. A task that runs again must see its rows in the same
    order, as it does when ``docs`` is read from files; write the result of a shuffle to a table first.
    """
    total = docs.agg(F.sum(F.octet_length(text_or_empty()) + PIECE_BYTES)).first()[0] or 0
    n_buckets = max(1, total // bucket_bytes)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(
        _pieces(path or default_tokenizer(), limit, n_buckets), f"doc_id {kind}, start long, tokens long, ids binary, doc_tokens long, bucket long"
    )
    return pieces.groupBy("bucket").applyInArrow(
        _pack(limit), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
