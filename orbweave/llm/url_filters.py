"""Operator 2: allow and block rules over URLs.

Every URL is expanded into host-suffix and path-prefix expressions, the expressions meet the rules in an equi-join on a
short prefix of their SHA-256, and the survivors are confirmed on the full digest and by rule precedence (the longest rule wins,
then the one with the longer host, then ``block``).

A URL has only the expressions whose number of host labels and of slashes some rule has, so what it expands to is bounded by the
rules' shapes and not by its own length, and each expression is a row of its own. A rule's path is cut after its last ``/``: the
first join finds the rules' directories, and the lengths of what rules have beyond them; the second one the whole rules. So the
join is exact for every rule path, not only for those that end in ``/``, and no directory brings its rules into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, join_counted, materialise, table

#: Fixed values of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rules up to this many are broadcast (each has at most a URL's length); more of them are joined by a salted shuffle.
BROADCAST_RULES = 50_000
SALTS = 16


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


#: A shape (host labels, slashes) as one number.
_SHAPE = 1 << 24


def _expressions(seen: DataFrame, shapes: list[int]) -> DataFrame:
    """A row for each URL (host, path) and shape that it has: the host's last labels and the path up to and with a slash."""
    known = F.expr(f"array({', '.join(f'{s}L' for s in shapes)})" if shapes else "cast(array() as array<bigint>)")
    has = F.filter(known, lambda s: (F.floor(s / _SHAPE) <= F.col("labels")) & (s % _SHAPE <= F.col("slashes")))
    rows = seen.withColumns({"labels": _count(F.col("host"), ".") + 1, "slashes": _count(F.col("path"), "/")})
    rows = rows.select("host", "path", F.explode(has).alias("s")).select("host", "path", F.expr(f"cast(s div {_SHAPE} as int)").alias("h"), F.expr(f"cast(s % {_SHAPE} as int)").alias("d"))
    return rows.select("host", "path", F.expr("substring_index(host, '.', -h)").alias("suffix"), F.when(F.col("d") == 0, "").otherwise(F.expr("concat(substring_index(path, '/', d), '/')")).alias("dir"))


def _meet(asked: DataFrame, digest: Column, rules: DataFrame, small: bool) -> DataFrame:
    """Rows of ``asked`` with the row of ``rules`` (rule_digest, unique, and others) of their digest: by its first four bytes, then all of it."""
    rules = rules.withColumn("short", _short(F.col("rule_digest")))
    asked = asked.withColumn("digest", digest).withColumn("short", _short(F.col("digest")))
    if small:
        met = asked.join(F.broadcast(rules), "short")
    else:  # a host suffix such as a top-level domain can hold a third of all expressions
        salted = rules.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"]).drop("salt")
    return met.where(F.col("digest") == F.col("rule_digest")).drop("digest", "rule_digest", "short")


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict.

    rules: host, path, verdict ('allow' or 'block'). Null and empty URLs, and those without ``://``, have an empty host and
    path, match no rule with a host, and get ``default``. Repeated rows stay repeated. Columns of ``urls`` named like the
    added ones are replaced. Rules with a null host, path or verdict are ignored; equal rules count once. Very long URLs cost no
    more expressions than there are shapes of rules.
    """
    rules = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
        .withColumn("dir", F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1))
        .withColumn("shape", (_count(F.col("rule_host"), ".") + 1).cast("long") * _SHAPE + _count(F.col("rule_path"), "/"))
    )
    rules = materialise(rules, "rules")
    small = rules.count() <= BROADCAST_RULES
    shapes = sorted(r["shape"] for r in rules.select("shape").distinct().collect())
    # lengths of what the rules of a directory have beyond it: distinct numbers, at most a path's length of them
    dirs = rules.groupBy(_digest(F.col("rule_host"), F.col("dir")).alias("rule_digest")).agg(F.collect_set(F.length("rule_path") - F.length("dir")).alias("more"))
    whole = rules.select(
        _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"), F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_len"), "verdict"
    )

    kept = [c for c in urls.columns if c not in {"host", "path", "rule", "verdict"}]
    rows = urls.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    seen = materialise(rows.select("host", "path").groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    asked = _expressions(seen, shapes)
    met = _meet(asked, _digest(F.col("suffix"), F.col("dir")), dirs, small)
    met = met.select("host", "path", "suffix", F.explode(F.transform("more", lambda m: m + F.length("dir"))).alias("upto")).where(F.length("path") >= F.col("upto"))
    met = met.withColumn("prefix", F.expr("substring(path, 1, upto)"))
    fits = _meet(met, _digest(F.col("suffix"), F.col("prefix")), whole, small)
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("len"), "host_len", "verdict", "rule")).alias("best"))
    judged = seen.join(best, ["host", "path"], "left").select("host", "path", "n", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_counted(rows, materialise(judged, "judged"), ["host", "path"], total).select(*kept, "host", "path", "rule", "verdict")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = {
    "op2_url_filters": r"""
with cut as (
  select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages
), parts as (
  select page_id, regexp_extract(rest, '^([^/?#]*)', 1) as h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), hosts as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts
), rules(rh, rp, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits as (
  select page_id, host, path, rh || rp as rule, verdict,
         row_number() over (partition by page_id order by length(rh || rp) desc) as k
  from hosts join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
)
select h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from hosts h left join fits f on h.page_id = f.page_id and f.k = 1
""",
}
