"""Importance resampling against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from rows import DOCS, docs, prose

from kifulake.llm import resampling

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def expected(rows, target):
    """(doc_id, text, n_features, weight, score) of each row and the scores that are drawn, in order."""
    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r.text)[1])
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out, able = [], []
    for r in rows:
        n, f = features(r.text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((r.doc_id, r.text, len(f), weight, score))
        if n >= 20:
            able.append((-score, -1 if r.doc_id is None else r.doc_id))
    return out, [d for _, d in sorted(able)[: len(able) * 25 // 100]]


def check(spark, d, target):
    rows = d.collect()
    got = resampling.resample(d, spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id int, text string")).collect()
    want, drawn = expected(rows, target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((a, c, w, s) for a, _, c, w, s in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [-1 if r.doc_id is None else r.doc_id for r in ranked] == drawn


def test_awkward(spark):
    check(spark, docs(spark), ["", None, prose(5, 90, 80), "É ñ ab cd ab cd", "one"])
    check(spark, docs(spark, [prose(i, 15 + i) for i in range(60)] * 2, repeat=False), [prose(3, 40), prose(4, 9)])


def test_no_target_and_no_documents(spark):
    check(spark, docs(spark), [])
    assert resampling.resample(spark.createDataFrame([], DOCS), docs(spark)).count() == 0


def test_crc_matrices():
    """Every length, also none and those beyond the matrices."""
    r = np.random.default_rng(1)
    parts = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in [0, 1, 1, 2, 7, 7, 7, 300, 2048, 2049, 70_000, 0, 3]]
    offsets = np.cumsum([0, *map(len, parts)])
    got = resampling.crc_matrices(np.frombuffer(b"".join(parts), np.uint8), offsets)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


def test_long_texts(spark):
    """A word of a million letters and a text of half a million words, whole."""
    check(spark, docs(spark, ["x" * 1_000_000 + " " + prose(1, 30), prose(2, 500_000), prose(3, 25)], repeat=False), [prose(2, 50)])
