"""SimHash and its links against plain loops."""

import re
from collections import Counter

import xxhash
from rows import DOCS, docs

from kifulake.llm import simhash
from kifulake.llm.components import components
from kifulake.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """fingerprint -> smallest reachable id, by all pairs."""
    fps = sorted(set(fp for _, fp in prints))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for d, fp in prints:
        if d is not None:
            r = find(fp)
            least[r] = min(least.get(r, d), d)
    return {fp: least.get(find(fp)) for fp in fps}


def check(rows, got):
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    want = classes(prints)
    assert Counter((d, f"{fp:016x}", want[fp]) for d, fp in prints) == Counter(got)


def test_awkward(spark):
    d = docs(spark)
    got = simhash.near_duplicates(d).collect()
    check(d.collect(), [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got])


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_balls"](spark, sf).collect()]
    check(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect(), got)


def test_dense_bucket_goes_through_balls(spark):
    """A cluster of many near fingerprints, and chains whose ends are far apart, lose no link."""
    import random

    r = random.Random(4)
    base = r.getrandbits(64)
    fps = {base}
    for _ in range(220):
        fps.add(base ^ (1 << r.randrange(22)) ^ (1 << r.randrange(22)) ^ (1 << r.randrange(64)))
    x = r.getrandbits(64)
    for b in range(0, 60, 4):
        x ^= 0xF << b
        fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {q.node: q.root for q in components(simhash.links(nodes)).collect()}
    want = classes(list(zip(signed, fps, strict=True)))
    groups = {}
    for s, f in zip(signed, fps, strict=True):
        groups.setdefault(want[f], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pigeonhole():
    """Some pair of blocks holds at most two of any four bits."""
    owner = [next(i for i, (low, w) in enumerate(simhash.BLOCKS) if low <= b < low + w) for b in range(64)]
    r = __import__("random").Random(1)
    for _ in range(5000):
        c = Counter(owner[b] for b in r.sample(range(64), 4))
        assert min(4 - c[i] for i in range(3)) <= 2
