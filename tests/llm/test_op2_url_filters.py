"""Tests of url filters."""

import random
import re

from llm_cases import pairs

from pyspark.sql import functions as F

from orbweave.llm import url_filters


def test_urls_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    hosts, paths = ["a.net", "x.a.net", "B.Net", "net", "deep.x.a.net", "a.org", "", "..", "a..net"], ["", "/", "/en", "/en/", "/en/x/y", "/env", "/e?q=/en/", "//", "/#x"]
    rules = [("net", "/", "block"), ("a.net", "/en", "allow"), ("x.a.net", "", "block"), ("net", "/en/x/", "block"), ("org", "/", "allow"), (None, "/", "block"), ("a.net", "/en", "allow")]
    urls = [None, "", "nothing", "://", "http://", "http://net", "http://a.net\n/en"] + [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, None, None, None)], "page_id long, url string, host string, extra string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted([(i, *brute(u)) for i, u in enumerate(urls)] + [(0, *brute(None))], key=repr)
    assert pairs(url_filters.filter_urls(df, table), "page_id", "host", "path", "rule", "verdict") == want
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)  # the salted join gives the same
    assert pairs(url_filters.filter_urls(df, table), "page_id", "host", "path", "rule", "verdict") == want
    assert url_filters.filter_urls(df.limit(0), table).count() == 0
    assert url_filters.filter_urls(df, table.limit(0)).where("rule is not null").count() == 0


def test_long_urls_expand_by_the_rules_only(spark):
    long_url = "http://" + ".".join(["a"] * 1000) + ".example.net/" + "d/" * 1000 + "end"
    urls = spark.createDataFrame([(1, long_url), (2, "http://x.example.net/d/d/en"), (3, "x" * 100_000)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/d/d/e", "allow"), ("example.net", "/d/d/d", "block"), ("b.net", "/d/d/d/x", "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.filter_urls(urls, rules).collect()}
    assert got == {1: ("example.net/d/d/d", "block"), 2: ("example.net/d/d/e", "allow"), 3: (None, "allow")}
    seen = urls.select(url_filters.host_of(F.col("url")).alias("host"), url_filters.path_of(F.col("url")).alias("path"))
    shapes = [h * url_filters._SHAPE + d for h, d in ((1, 1), (2, 2), (2, 3))]
    assert url_filters._expressions(seen.where("length(host) > 100"), shapes).count() == 3


def test_a_directory_of_many_rules(spark):
    rules = spark.createDataFrame([("a.net", f"/dir/{i}", "block" if i % 2 else "allow") for i in range(3000)], "host string, path string, verdict string")
    urls = spark.createDataFrame([(i, f"https://w.a.net/dir/{i}?q") for i in range(0, 4000, 7)], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filters.filter_urls(urls, rules).collect()}
    want = {i: max((f"a.net/dir/{str(i)[:k]}" for k in range(1, 5) if str(int(str(i)[:k])) == str(i)[:k] and int(str(i)[:k]) < 3000), key=len) for i in range(0, 4000, 7)}
    assert got == want
