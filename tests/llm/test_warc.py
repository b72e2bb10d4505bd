"""Archives: round trip of every page through the index."""

import hashlib
from collections import Counter

from rows import prose

from kifulake.llm import warc

PAGES = "page_id long, url string, html string, file string"


def pages():
    big, other = "<p>" + prose(1, 300) + "</p>", "É" * 600
    data = [
        (5, "http://b.example.com/x", big), (9, "http://a.example.com/y?z#f", big), (7, None, big), (None, "http://n.example/", big), (9, "http://a.example.com/y?z#f", big),
        (1, "http://a.example.com/y?z", other), (2, "http://a.example.com/y?z", other), (3, "HTTP://A.example.com:80/t\tab\nnl", "small"), (4, "x", "small"), (6, "", None), (8, "http://e/", ""),
        (None, "http://u/", other + "!"), (None, "http://u/", other + "!"), (10, "http://long/", prose(2, 60_000, 5000)),
    ]
    return [(*r, "f") for r in data]


def expected(rows):
    best = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = b in best and i != best[b]
        yield (i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[b] if again else None)


def found(spark, d):
    parts, index, archives = warc.archive(d)
    keys = d.select(warc.capture_key(d.url, d.page_id).alias("key"))
    return warc.lookup(keys, parts, index, archives)


def test_round_trip(spark):
    rows = pages()
    d = spark.createDataFrame(rows, PAGES)
    got = found(spark, d).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(expected(rows))
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")


def test_many_blocks_and_missing_keys(spark):
    d = spark.range(9000).selectExpr("id page_id", "concat('http://h', id % 3, '.net/p') url", "concat('x', id) html")
    parts, index, archives = warc.archive(d)
    some = d.where("page_id % 100 = 0")
    keys = spark.createDataFrame([("net,h0)/q",), ("",), ("zzz",)], "key string").union(some.select(warc.capture_key(some.url, some.page_id).alias("key")))
    got = warc.lookup(keys, parts, index, archives).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(i, f"x{i}") for i in range(0, 9000, 100)]


def test_empty(spark):
    assert found(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_reversed_host(spark):
    rows = spark.createDataFrame([("http://www.Example.com:80/a?b#c",), (None,), ("a.b",)], "url string")
    assert [r[0] for r in rows.select(warc.surt(rows.url)).collect()] == ["com,example,www:80)/a?b", "", "b,a)"]
