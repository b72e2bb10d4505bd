"""Mixing against exact fractions."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

from rows import CLASHES, DOCS, docs, prose

from kifulake.llm import mixing


def targets(sizes):
    """Shares by weight with caps, in rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**share, **fixed}
        fixed |= {s: Fraction(3 * sizes[s]) for s in over}


def compare(d):
    got = mixing.mix(d, 3).collect()
    rows = d.collect()
    assert len(got) == len(rows)
    sizes, docs_of, taken = defaultdict(int), defaultdict(list), defaultdict(int)
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += n
        docs_of[r.source].append(n)
    want = targets(sizes)
    for r in got:
        assert r._mix_source_size == sizes[r.source]
        assert abs(r._mix_target - float(want[r.source])) <= 1e-9 * max(1, float(want[r.source]))
        assert 0 <= r._mix_copies <= 3
        taken[r.source] += r._mix_copies * r._mix_size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * max(docs_of[s], default=0) + 3
    again = mixing.mix(d.repartition(3), 3).collect()
    plain = lambda rs: Counter((r.doc_id, r.text, r.source, r._mix_copies) for r in rs)
    assert plain(got) == plain(again)
    assert [f for f in d.columns if f not in got[0].asDict()] == []
    assert all(r[c] == c for r in got for c in CLASHES)


def test_awkward(spark):
    compare(docs(spark))
    compare(docs(spark, [prose(i, 5 + 7 * i % 300) for i in range(80)], sources=("big", "big", "big", "big", "b", None, "c", "d\U0001f600", "")))


def test_empty_and_sizeless(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS), 3).count() == 0
    got = mixing.mix(docs(spark, [None, "", "  "], repeat=False), 3).collect()
    assert [r._mix_size * r._mix_copies for r in got] == [0, 0, 0]


def test_hot_source_is_not_one_task(spark):
    """Rows of one source are dealt into ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    d = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', int(id % 50)) text", "'hot' source")
    rows, manifest = mixing.numbered(d, [mixing.F.col("source"), mixing.F.col("doc_id")], "n", "t", ["source"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and manifest.agg({"_n": "max"}).first()[0] < 4000
    assert sorted(r.n for r in rows.select("n").collect()) == list(range(4000))


def test_a_source_per_site(spark):
    """Many sources: shares by exact rounds, and no window or hinted broadcast over them."""
    sizes = spark.range(3000).selectExpr("if(id = 7, null, concat('site-', id)) source", "(id * id * 7919) % 5003 * (id % 3) source_size")
    plan = mixing.source_targets(sizes)
    got = {r.source: r for r in plan.collect()}
    want = targets({s: r.source_size for s, r in got.items()})
    assert all(abs(r.target - float(want[s])) <= 1e-6 for s, r in got.items())
    assert "Window" not in plan._jdf.queryExecution().toString()
