"""Quality rules against plain loops."""

import re
from collections import Counter

import pytest
from rows import DOCS, docs

from kifulake.llm import quality
from kifulake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_statistics(spark):
    d = docs(spark)
    got = quality.judge(d, spark.createDataFrame([], "doc_id long, quality int"))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    have = sorted(((r.doc_id is None, r.doc_id or 0), *(r[c] for c in cols)) for r in got.collect())
    want = sorted(((r.doc_id is None, r.doc_id or 0), *brute(r.text)) for r in d.collect())
    assert have == want
    assert all(r.kept == (not r.base_failed) for r in got.collect())  # nothing to learn from


def test_empty(spark):
    d = spark.createDataFrame([], DOCS)
    assert quality.judge(d, spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_learns_a_conjunction():
    rows, bad = [], []
    for i in range(900):
        r = {f: float((i * p) % 97) / 97 for f, p in zip(quality.FEATURES, (3, 5, 7, 11, 13, 17, 19, 23), strict=True)}
        rows.append(r)
        bad.append(r["symbols"] > 0.5 and r["repeats"] <= 0.4)
    found = quality.learn(rows, bad)
    said = [any(x.matches(r) for x in found.rules) for r in rows]
    assert sum(a == b for a, b in zip(said, bad, strict=True)) >= 0.97 * len(rows)
    assert quality.learn([], []).rules == () and quality.learn(rows, [False] * len(rows)).rules == ()


@pytest.mark.parametrize("name", ["op4_quality_rules"])
def test_query(spark, name):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs_)
    for d in docs_:
        g = got[d.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(d.text)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    usable = [(labels[i], g.kept) for i, g in got.items() if i in labels and not g.base_failed]
    good = [k for q, k in usable if q == 1]
    poor = [k for q, k in usable if q == 0]
    print(len(good), sum(good), len(poor), sum(poor))
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.3 * len(poor)


@pytest.mark.parametrize("want", [1, 7, 300, 5000])
def test_hash_cut(spark, want):
    from pyspark.sql import functions as F

    from kifulake.llm.common import hash_cut

    rows = spark.range(900).select(F.xxhash64("id").alias("h")).union(spark.range(300).select(F.xxhash64(F.lit(5)).alias("h")))
    cut = hash_cut(rows, F.col("h"), want)
    hashes = sorted(r.h for r in rows.collect())
    if want > len(hashes):
        assert cut is None
    else:
        held = sum(h <= cut for h in hashes)
        assert want <= held <= want + max(want, 300) and cut >= hashes[want - 1]


def test_the_sample_is_the_smallest_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    n = 3000
    words = F.when(F.col("id") % 10 < 8, 5).otherwise(30)  # four in five fail the base rules, so the bound must rise
    stats = spark.range(n).select(
        F.col("id").alias("doc_id"), words.cast("long").alias("n_words"),
        *[(F.col("id") % k).alias(c) for k, c in ((7, "word_chars"), (3, "n_symbols"), (2, "n_dup_lines"), (5, "n_capitals"), (4, "n_marks"), (6, "n_digits"))],
        F.lit(0).cast("long").alias("n_repeat_words"),
    )
    labels = spark.range(0, 2 * n, 2).select(F.col("id").cast("int").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("quality"))
    kept = {}
    monkeypatch.setattr(quality, "learn", lambda rows, bad: kept.update(rows=rows, bad=bad))
    for size in (20, 10_000):
        quality.fit(stats, labels, size)
        usable = stats.where("n_words >= 20 AND doc_id % 2 = 0 AND doc_id % 3 <> 0").select("doc_id", F.xxhash64("doc_id").alias("h"), "n_capitals", "n_words")
        want = sorted((r.h, r.doc_id, r.n_capitals / r.n_words) for r in usable.collect())[:size]
        assert [r["capitals"] for r in kept["rows"]] == [w[2] for w in want] and kept["bad"] == [w[1] % 5 == 0 for w in want]
