"""URL verdicts and cascades against plain sets."""

import re

from rows import prose

from kifulake.llm import url_filter as uf

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://a.NET/x", "http://net/", "https://Example.net/en/x?q=/de/", "http://sub.example.net/en", "http://notexample.com/de/",
    "http://example.com/de/a", "http://www.example.com/de", "http://x.org/fr/", "http://x.org:80/fr/", "http://bad.io/a#b", "http://deep.bad.io?x=://y", "http://good.io/://z", "//a.net/",
    "http://net#/", "http://É.net/é", "http://a.net/é/en/", "http:///path", "http://..net/", "http://a\nb.net/x\ny",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, listed):
    host, path = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(host == s or host.endswith("." + s) for s in listed) else "allow"


def test_awkward(spark):
    listed = ["bad.io", "other.example"]
    d = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, rule string, verdict string")
    keys = spark.createDataFrame([(x,) for x in [*listed, None, "bad.io"]], "key string")
    got = uf.judge(d, RULES, keys).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute(u, listed) for u in URLS + URLS[:3]]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(pages, RULES, spark.createDataFrame([], "key string")).count() == 0
    one = spark.createDataFrame([(1, "http://bad.io/")], "page_id long, url string")
    assert uf.judge(one, [], spark.createDataFrame([], "key string")).first().verdict == "allow"


def test_cascade_is_exact_and_deep(spark):
    """A crowded universe passes level 0 by mistake and needs further levels."""
    universe = spark.range(60_000).selectExpr("concat('k', id) key")
    listed = universe.where("pmod(xxhash64(key), 40) = 0")
    cascade = uf.build_cascade(listed, universe.union(universe))
    assert len(cascade.levels) >= 2
    wrong = universe.withColumn("has", cascade.has(uf.F.col("key"))).where("has <> (pmod(xxhash64(key), 40) = 0)")
    assert wrong.count() == 0


def test_keys_longest_first(spark):
    text = prose(1, 3)
    r = spark.range(1).select(uf.rule_keys(uf.F.lit("a.b.c"), uf.F.lit("/en/x" + text), [(n, m) for n in (1, 2, 3, 9) for m in (1, 4)]).alias("k")).first()
    assert r.k[0] == "a.b.c/en/" and set(r.k) == {s + p for s in ("a.b.c", "b.c", "c") for p in ("/", "/en/")}


def test_level_zero_widens_with_the_corpus(spark):
    """Two keys among 300,000: the mistakes of the first level do not outnumber the list."""
    universe = spark.range(300_000).selectExpr("concat('u', id) key")
    listed = universe.where("key in ('u7', 'u70000')")
    cascade = uf.build_cascade(listed, universe)
    assert cascade.levels[0][0] > 2 * uf.BITS_PER_KEY and all(bits <= 64 for bits, _ in cascade.levels[1:])
    assert [r.key for r in universe.where(cascade.has(uf.F.col("key"))).orderBy("key").collect()] == ["u7", "u70000"]


def test_hosts_of_many_labels(spark):
    """A host of 100,000 labels is judged by its rule and by the list like any other, and in seconds."""
    long = ".".join(["a"] * 100_000)
    urls = [f"http://{long}.net/x", f"http://{long}.bad.io/x", f"http://{long}.good.io/", f"http://{long}.example.com/de/1"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    keys = spark.createDataFrame([("bad.io",), ("x.y.z.bad.example",)], "key string")
    got = uf.judge(d, RULES, keys).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("net/", "block"), (None, "block"), (None, "allow"), ("example.com/de/", "block")]
    assert got[0].host == f"{long}.net"


def test_no_row_comes_from_python(spark, monkeypatch):
    pages = spark.range(50).selectExpr("id page_id", "concat('http://h', id % 9, '.io/', id) url")
    listed = spark.range(1).selectExpr("'h3.io' key")
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    got = uf.judge(pages, RULES, listed)
    assert got.where("verdict = 'block'").count() == 6
