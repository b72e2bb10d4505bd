"""The shingle-set join against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from rows import DOCS, docs, prose

from kifulake.llm import set_join
from kifulake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def expected(rows):
    """(doc_id, n_shingles, component_id) of each (doc_id, text), over all pairs that share a shingle."""
    sets = {}
    holders = defaultdict(list)
    for _, t in rows:
        s = shingles(t)
        if s and s not in sets:
            sets[s] = len(sets)
    order = list(sets)
    for s, i in sets.items():
        for x in s:
            holders[x].append(i)
    parent = list(range(len(order)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(order):
        for j, shared in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * shared >= 90 * (len(s) + len(order[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for d, t in rows:
        s = shingles(t)
        if s and d is not None:
            r = find(sets[s])
            least[r] = min(least.get(r, d), d)
    return Counter((d, len(shingles(t)), least.get(find(sets[shingles(t)])) if shingles(t) else d) for d, t in rows)


def check(d):
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    got = set_join.linked_sets(d).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected(rows)


def copies(seed, n, length, edits):
    """Copies of one text with up to ``edits`` words changed each."""
    r = random.Random(seed)
    base = prose(seed, length, 400).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(length)] = f"new{r.randrange(100_000)}"
        out.append(" ".join(w))
    return out


def test_awkward(spark):
    check(docs(spark))


def test_empty(spark):
    assert set_join.linked_sets(spark.createDataFrame([], DOCS)).count() == 0


def test_sizes_and_edges_of_bands(spark):
    """Pairs that are just linked or just not, at many sizes."""
    texts = []
    for n in [*range(3, 60), 100, 139, 140, 141, 400, 900, 2000]:
        base = prose(n, n, 5000).split()
        for gone in sorted({0, 1, n // 20, n // 19, n // 10, n // 10 + 1, n // 9}):
            texts.append(" ".join(base[: n - gone]))
            texts.append(" ".join(base[: n - gone] + [f"w{n}{i}" for i in range(gone)]))
    check(docs(spark, texts, repeat=False))


@pytest.mark.parametrize("side", [1024, 40])
def test_large_groups_of_near_copies(spark, monkeypatch, side):
    """Groups far over a bucket, of which some members are linked only with others than the centre."""
    monkeypatch.setattr(set_join, "BUCKET", 8)
    monkeypatch.setattr(set_join, "SIDE", side)
    texts = copies(1, 150, 60, 4) + copies(2, 80, 200, 9) + copies(3, 60, 30, 1) + [prose(i, 50) for i in range(40)]
    check(docs(spark, texts, repeat=False))


def test_sketch_bounds_the_difference():
    """Hamming distance never exceeds the symmetric difference, and linked sets agree on a kept signature."""
    r = np.random.default_rng(4)
    for n in [1, 2, 5, 9, 10, 19, 20, 57, 140, 400, 1500]:
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        for gone in {0, 1, n // 20, n // 10, n // 2}:
            b = np.concatenate((a[gone:], r.integers(0, 1 << 63, gone // 2, dtype=np.uint64)))
            if not len(b):
                continue
            apart = gone + gone // 2
            for blocks in (1, 7, 40):
                x, y = set_join.sketches(a, blocks), set_join.sketches(b, blocks)
                assert np.bitwise_count(x ^ y).sum() <= apart
            small = [set_join._small(x, np.array([0, len(x)])) for x in (a, b)]
            assert np.bitwise_count(small[0] ^ small[1]).sum() <= apart
            if 100 * (n - gone) >= 90 * (n + gone // 2):
                at = set_join.bands(4 * n)
                assert np.intersect1d(set_join._signatures(a, at), set_join._signatures(b, at)).size


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op11_parity_join"](spark, sf).collect())
    assert got == expected([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
