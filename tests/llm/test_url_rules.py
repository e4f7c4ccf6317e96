import random
from collections import Counter

from pyspark.sql import types as T

from llm.queries import RULES
from llm.url_rules import filter_urls

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), *[
    T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict", "digest", "short", "best", "id", "labels", "chars", "html")]])


def pages(spark, urls):
    return spark.createDataFrame([(i, u) + ("x",) * 11 for i, u in urls], PAGE).repartition(3)


def rules(spark, some=RULES):
    return spark.createDataFrame(some, "host string, path string, verdict string")


def plain(url, some=RULES):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c < "\x80" else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in some if None not in (h, p, v)
            if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p) and not set(h) & set("/?#")]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, None if best[2] is None else best[2].lower() if best[2] != best[2].lower() else best[2], best[3]


def check(spark, urls, some=RULES):
    got = Counter(tuple(r) for r in filter_urls(pages(spark, urls), rules(spark, some)).collect())
    assert got == Counter((i, *plain(u, some)) for i, u in urls)


def test_rules_and_awkward_urls(spark):
    urls = ["http://example.org/es/1", "http://a.b.example.org/en/12?x=/es/", "http://example.org/en/21", "HTTP://EXAMPLE.ORG/ES/", "x://ÉXAMPLE.org/es/",
            "http://notexample.org/es/", "http://example.org.evil.com/de/x", "https://com/fr/", "https://a.com/fr", "http://org", "http://org/",
            "http://org?/", "http://a.org#/es/", "://x.org/", "no scheme", "", None, "http://", "http:///es/", "a://b://c.org/", "http://..org/es/",
            "http://example.org:80/es/", "http://me@example.org/es/", "http://example.org/es/\nline", "http://" + "a." * 3000 + "org/" + "p/" * 3000]
    check(spark, list(enumerate(urls)) + [(None, urls[0]), (7, urls[0]), (7, urls[0])])


def test_random_urls_equal_a_plain_search(spark):
    rng = random.Random(4)
    some = [(rng.choice(["a.b", "b", "c.a.b", "c"]), rng.choice(["", "/", "/x", "/x/", "/x/y", "/xx"]), rng.choice(["allow", "block"])) for _ in range(9)]
    some += [("b", "no slash", "block"), ("b/x", "/", "block"), (None, "/", "block"), ("b", None, "block"), ("b", "/", None)]
    urls = [(i, f"h://{'.'.join(rng.choices('abc', k=rng.randint(1, 4)))}{rng.choice(['', '/', '/x', '/x/y/z', '/xx', '?q', '#f'])}") for i in range(300)]
    check(spark, urls, some)


def test_no_pages_and_no_rules(spark):
    assert filter_urls(pages(spark, []), rules(spark)).count() == 0
    rows = filter_urls(pages(spark, [(1, "http://a.org/")]), rules(spark, []), default="block").collect()
    assert [tuple(r) for r in rows] == [(1, "a.org", "/", None, "block")]


def test_many_rules_are_joined_without_a_broadcast(spark, monkeypatch):
    from llm import url_rules

    monkeypatch.setattr(url_rules, "small", lambda df: df)
    check(spark, [(i, f"http://h{i % 7}.org/es/{i}") for i in range(60)])
