"""Removal of repeated spans against plain loops."""

import hashlib
import random
import re

import numpy as np
from rows import DOCS, docs

from kifulake.llm import substrings
from kifulake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
W = 20


def brute(pairs):
    """{(doc_id, text): (n_words, n_removed, sha)} of distinct (doc_id, text hash order, text)."""
    seen, out = set(), {}
    for d, _, text in pairs:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - W + 1):
            w = tuple(words[i : i + W])
            if w in seen:
                gone.update(range(i, i + W))
            seen.add(w)
        kept = " ".join(x for i, x in enumerate(words) if i not in gone)
        out[d, text] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def ordered(df):
    rows = df.selectExpr("doc_id", "xxhash64(text) h", "text").distinct().collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def compare(df, got):
    want = brute(ordered(df))
    expect = sorted(((r.doc_id is not None, r.doc_id or 0), *want[r.doc_id, r.text]) for r in df.collect())
    assert sorted(got) == expect


def run(df):
    return [((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(df).collect()]


def test_awkward(spark):
    d = docs(spark)
    compare(d, run(d))


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_periodic_and_shared(spark):
    """Runs, periods of every length, and passages of just 20 words at text edges."""
    r = random.Random(8)
    passage = [f"p{i}" for i in range(20)]
    texts = [" ".join(["a"] * n) for n in (19, 20, 21, 70)]
    texts += [" ".join(f"q{p}x{i % p}" for i in range(90)) for p in range(2, 24)]
    for k in range(12):
        filler = [f"f{k}_{r.randrange(50)}" for _ in range(r.randrange(60))]
        at = (0, len(filler), len(filler) // 2)[k % 3]
        texts.append(" ".join(filler[:at] + passage[k // 11 :] + filler[at:]))
    texts += [" ".join(r.choice("xy") for _ in range(300)) for _ in range(6)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    compare(d, run(d))


def test_equal_windows_elect_alike():
    """The key of a window depends on its words alone."""
    r = np.random.default_rng(3)
    codes = r.integers(1, 40, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.array([0, 700, 1500, 1510, 3000])
    codes[2000:2060] = codes[100:160]
    codes[690:700] = codes[1500:1510]
    key, head, size = substrings.elect(codes, first)
    elected = {}
    for k, h, s in zip(key.tolist(), head.tolist(), size.tolist(), strict=True):
        for w in range(h, h + s):
            assert elected.setdefault(tuple(codes[w : w + W].tolist()), k) == k
    assert sum(size.tolist()) == int(substrings.window_starts(first).sum())


def test_words_of_equal_hash_structure(spark):
    """Long words that a polynomial modulo 2^64 cannot tell apart: the Thue-Morse text and its complement."""
    lead = " ".join(f"w{i}" for i in range(19))
    texts = []
    for n in (1024, 2048, 4096):
        bits = [bin(i).count("1") & 1 for i in range(n)]
        texts += [f"{lead} " + "".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = run(d)
    assert all(g[2] == 0 for g in got)
    compare(d, got)


def test_pieces(monkeypatch):
    """A text worked in pieces elects the same keys window by window."""
    r = np.random.default_rng(5)
    codes = r.integers(1, 30, 2000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.array([0, 90, 90, 1900, 2000])
    spread = lambda parts: {h + j: k for k, h, s in zip(*(x.tolist() for x in parts), strict=True) for j in range(s)}
    whole = spread(substrings.elect(codes, first))
    for piece in (1, 64, 777):
        monkeypatch.setattr(substrings, "PIECE", piece)
        assert spread(substrings.elect_in_pieces(codes, first)) == whole


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = [((r.doc_id is not None, r.doc_id or 0), r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_recompressed_repeats"](spark, sf).collect()]
    compare(spark.read.parquet(f"{sf}/documents.parquet"), got)
