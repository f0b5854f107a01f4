"""URL rules against setting every rule against every URL."""

import random

from pyspark.sql import functions as F

from quillstone.llm import url_rules


def plain(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if None not in (v, h, p) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else otherwise


def test_host_and_path(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET", "http://a.b?x://y/z", "x://h#f/p", "https://ÄB.org/De/é?q", "http://u@h:80/p/../q#", "a://b://c/d", "http://a\nb.net/p\nq?r"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    found = frame.select("url", *(c.alias(n) for c, n in zip(url_rules.host_and_path(F.col("url")), ("host", "path"), strict=True))).collect()
    for r in found:
        assert (r["host"], r["path"]) == plain(r["url"], [])[:2]


def check(spark, urls, rules, **settings):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id bigint, url string, rule string, key string").repartition(4)
    found = url_rules.judged(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), **settings).collect()
    assert len(found) == len(urls) and all(r["key"] == "y" for r in found)
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(r["url"], rules, **settings), r["url"]


def test_rules_of_the_query(spark):
    hosts = ["net", "example.net", "a.example.net", "notexample.net", "example.com", "www.example.com", "x.org", "org", "net.org", "example.net.", "b..net", "xnet"]
    paths = ["", "/", "/en/", "/en", "/de/1", "/fr/", "/fr/x", "/EN/"]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/en/", "#/de/")]
    check(spark, urls + [None, "", urls[3], urls[3]], list(url_rules.RULES))


def test_many_nested_rules(spark):
    """Rules of several depths on hosts and paths, deep hosts, one very common URL and one very long."""
    draw = random.Random(5)
    names, folders = ["a", "b", "ab", "c.d"], ["a", "b/", "ab", "", "é", "\U0001f600"]
    host = lambda most: ".".join(draw.choice(names) for _ in range(draw.randint(1, most)))
    path = lambda most: "".join("/" + draw.choice(folders) for _ in range(draw.randint(0, most)))
    rules = sorted({(host(3), path(3)) for _ in range(150)})
    rules = [(draw.choice(["allow", "block"]), h, p) for h, p in rules]
    urls = [f"http://{host(5)}{path(4)}" for _ in range(1500)] + ["http://b.a/a/b//"] * 500 + ["http://b.a/a/" + "x" * 300_000, "http://" + "a." * 5000 + "b/"]
    check(spark, urls, rules, otherwise="block")


def test_odd_rules(spark):
    rules = [("allow", "a.b", "/x"), ("allow", None, "/"), ("block", "b", None), (None, "b", "/"), ("block", "b", "x"), ("block", "a/b", "/"), ("block", "", "/q"), ("allow", "b", "")]
    check(spark, ["http://a.b/x", "http://b", "http://c.b/y", "http:///q", "http://b/x", "http://a/b/", "x"], rules)
    twice = spark.createDataFrame([("allow", "A.b", "/x"), ("block", "a.b", "/x")], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.b/x")], "page_id bigint, url string")
    assert [r["verdict"] for r in url_rules.judged(pages, twice).collect()] == ["block"]
    assert url_rules.judged(pages.limit(0), twice).collect() == []
    assert [(r["rule"], r["verdict"]) for r in url_rules.judged(pages, twice.limit(0)).collect()] == [(None, "allow")]
