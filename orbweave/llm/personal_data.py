"""Operator 7: personal data, by fixed patterns and a conditional random field.

Patterns find addresses and numbers with a fixed form. A linear-chain conditional random field over word shapes, trained from a
small labelled table, adds what has none: secrets, personal identifiers and e-mail addresses that are spelled out. Its spans
never change those of the patterns; one that overlaps such a span is left out.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table
from .crf import TAGS, Crf, train
from .packing import grouped

BASE = ["email", "ip", "card", "phone"]
KINDS = BASE + TAGS[1:]

# Fixed values. A number can begin only where no digit stands before it, as a run of digits matches from its start or not at
# all; an address begins where the run of its local part does. So no pattern is tried again within a long run.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
_WORD = re.compile(r"\S+")
#: A tagged word without the symbols around it.
_CORE = re.compile(r"[0-9A-Za-z](?:\S*[0-9A-Za-z])?")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' spans, by start and then kind."""
    found = [(a, z, "email") for a, z in _emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            # a part's value is at most 255, however many zeros lead it
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def field_spans(text: str, tagged: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the field's tags (word, tag) that overlap no base span; neighbouring words of one tag are one span."""
    if not tagged:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    out: list[tuple[int, int, str]] = []
    last = -2
    for word, tag in tagged:
        a, z = places[word]
        core = _CORE.search(text, a, z)
        if not core:
            continue
        a, z = core.span()
        if out and word == last + 1 and out[-1][2] == TAGS[tag]:
            out[-1] = (out[-1][0], z, TAGS[tag])
        else:
            out.append((a, z, TAGS[tag]))
        last = word
    return [s for s in out if all(s[1] <= b[0] or b[1] <= s[0] for b in base)]


def labelled_rows(nth: tuple[int, int] | None = None) -> list[tuple[list[str], list[str]]]:
    """The small labelled table (words, tags), written by rule from a few sentence patterns with a fixed seed.

    ``nth`` (k, n) leaves out each n-th pattern, from the k-th on: for tests on sentences of patterns that aren't learnt.

    In a pattern {S} is a secret, {I} an identifier, {E} a spelled-out address; {w} an invented lower-case word, {W} one with a
    capital, {N} a number, {J} a word with symbols around it, {P} personal data that the fixed patterns find.
    """
    r = random.Random(20)
    syllables = "an ba de er fo gu hi ion ka le mo ni or pa qui re sta ti un vé wer za schö ñe ung ção".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def hexed() -> str:
        return "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 20, 24, 32, 40, 48, 64])))

    def mixed() -> str:
        return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(20, 44)))

    def secret() -> str:
        return r.choice([hexed(), hexed(), mixed(), f"sk-{mixed()}", f"ghp_{mixed()}", f"AKIA{mixed()[:16].upper()}"])

    def digits(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def identifier() -> str:
        return f"{digits(3)}-{digits(2)}-{digits(4)}"

    def spelled() -> str:
        return " ".join([word(), r.choice(["(at)", "[at]"]), word(), r.choice(["(dot)", "[dot]"]), r.choice(["com", "org", "net"])])

    def personal() -> str:
        return r.choice([f"{word()}@{word()}.example.com", ".".join(str(r.randint(0, 255)) for _ in range(4)), digits(16), f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"])

    fill = {
        "S": lambda: r.choice(['"{}"', "{}", "'{}'", "{},", "{}."]).format(secret()),
        "I": lambda: r.choice(["{}", "{}.", "{},"]).format(identifier()),
        "E": spelled,
        "w": lambda: word() + r.choice(["", "", "", "", ",", "."]),
        "W": lambda: word().capitalize(),
        "N": lambda: r.choice([digits(r.randint(1, 6)), f"{digits(2)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}/{digits(2)}"]),
        "J": lambda: r.choice(["{}!!", "{}###", "{}$$$", "{} |", "{}%%%", "{}&&&", "{}***"]).format(r.choice([word(), word().upper()])),
        "P": personal,
    }
    patterns = (
        ["token = {S}", "{w} {w} token = {S} {w} {w}", "{W} {w} key = {S} {w}", "api key: {S}", "password is {S} {w}", "{w} secret = {S} {w} {w}", "bearer {S}"]
        + ["{w} ssn {I} {w}", "{W} {w} {I} {w} {w}", "ssn: {I}", "{w} {w} number {I} {w}"]
        + ["{w} {E} {w} {w}", "{W} {w} {w} {E}"]
        + ["{W} {w} {w} {w} {w} {w} {w} {w}", "{w} {w} {w} {w} {W} {w} {w} {w}", "{J} {J} {J} {J} {w}", "{w} {N} {w} {w} {N}", "{W} {w} {P} {w} {w}", "{J} {P} {J} {w}"]
        + ["{w} token {w} {w} key {w}", "{w} = {w} {w} : {N}", "{W} at {w} dot {w} {w}", "{w} number {N} {w} id {N}", "{w}", "{W} {w}. {W} {w} {w}", "{J} {N} {J}"]
    )
    rows = []
    if nth:
        patterns = [p for i, p in enumerate(patterns) if i % nth[1] != nth[0]]
    for p in patterns * 14:
        words, tags = [], []
        for piece in p.split(" "):
            m = re.fullmatch(r"\{(\w)\}(\.?)", piece)
            kind = {"S": "secret", "I": "id", "E": "spelled_email"}.get(m[1], "O") if m else "O"
            for x in ((fill[m[1]]() + m[2]) if m else piece).split(" "):
                words.append(x)
                tags.append(kind)
        rows.append((words, tags))
    return rows


@functools.cache
def default_field() -> Crf:
    """The field of the labelled table, trained once in a driver's life."""
    return train(labelled_rows())


def _scan(field: Crf, kept: list[str], names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for texts in grouped(t.as_py() or "" for t in batch.column("text")):
                for text, tagged in zip(texts, field.decode([t.split() for t in texts]), strict=True):
                    own = base_spans(text)
                    base.append(own)
                    every.append(sorted(own + field_spans(text, tagged, own), key=lambda x: (x[0], KINDS.index(x[2]))))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            cols = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in x] for x in rows], kind) for rows in (base, every)]
            yield pa.record_batch([*(batch.column(c) for c in kept), *cols], names=[*kept, *names])

    return run


def find(docs: DataFrame, kept: list[str], rows: list[tuple[list[str], list[str]]] | None = None, names: tuple[str, str] = ("base", "every")) -> DataFrame:
    """The columns ``kept`` of every row of ``docs``, with base and every: arrays of (start, end, kind), in code points, end exclusive.

    The two go by ``names``; columns of those names are replaced. Null and empty texts have no spans; repeated rows have equal spans. ``rows`` replaces the labelled table. The model's size
    is that of its table's features, some thousand numbers.
    """
    field = default_field() if rows is None else train(rows)
    small_batches(docs.sparkSession)
    kept = [c for c in kept if c not in names]
    schema = docs.select(*kept).schema
    element = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*schema.fields, *(T.StructField(n, element) for n in names)])
    return docs.select(*(kept if "text" in kept else ["text", *kept])).mapInArrow(_scan(field, kept, names), schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (text and others), each span replaced by its kind in brackets; n_chars, if there is one, follows the text.

    Of overlapping spans the first one gives the name, and the replaced part reaches to the end of the last.
    """
    kept = docs.columns
    found = find(docs, kept, names=("__base", "__every"))

    def join(a, s):
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(out.otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    rest = lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.size("__every") > 0, F.aggregate("__every", start, join, rest)).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in kept:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size("__every") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*kept)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), ["doc_id"])
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(join("base"), 256).alias("base_sha256"), join("every").alias("spans"))
