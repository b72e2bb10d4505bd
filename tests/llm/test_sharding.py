"""The permutation against plain integers."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from rows import CLASHES, DOCS, docs

from kifulake.llm import sharding
from kifulake.llm.queries import QUERIES, SHARD_SEED, SHARDS


def feistel(x, a, b, seed):
    left, right = divmod(x, b)
    for i in range(sharding.ROUNDS):
        f = lambda v: int(hashlib.md5(f"{seed}:{i}:{v}".encode()).hexdigest()[:8], 16)  # noqa: E731, B023
        if i % 2 == 0:
            left = (left + f(right)) % a
        else:
            right = (right + f(left)) % b
    return left * b + right


def permuted(x, n, seed):
    a, b = sharding.grid(n)
    x = feistel(x, a, b, seed)
    while x >= n:
        x = feistel(x, a, b, seed)
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 101, 300])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select("id", sharding.permute(F.col("id"), n, 9).alias("p")).orderBy("id").collect()]
    assert got == [permuted(i, n, 9) for i in range(n)]
    assert sorted(got) == list(range(n))


def test_awkward(spark):
    d = docs(spark)
    rows = sharding.shard(d, 4, 5).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == d.count() and max(counts.values()) - min(counts.values()) <= 1
    assert all(r[c] == c for r in rows for c in CLASHES)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(c)) for s, c in counts.items())
    plain = lambda rs: Counter((r.doc_id, r.text, r.n_chars, r.shard, r.slot) for r in rs)
    assert plain(rows) == plain(sharding.shard(d.repartition(3), 4, 5).collect())


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS), 4, 5).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op8_feistel_shards"](spark, sf).collect()}
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for i, r in enumerate(rows):
        p = permuted(i, len(rows), SHARD_SEED)
        raw, g = (r.text or "").encode(), got[r.doc_id]
        assert (g["size"], g.text_crc32, g.law, g.shard, g.slot, g.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", p % SHARDS, p // SHARDS, None)
