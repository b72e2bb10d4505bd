"""The pipeline against a brute-force composition, and the SQL of the other queries."""

import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
from check import compare, connect
from rows import DOCS, docs
from pyspark.sql import functions as F
from test_decontaminate import brute as windows
from test_mixing import targets
from test_simhash import classes, fingerprint

import corpus_pipeline
from kifulake.llm import language, mixing, stages
from kifulake.llm.queries import QUERIES, SQL


def write(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}.parquet")


def survivors(rows, items):
    rows = [r for r in rows if r.text and any(c.isalpha() for c in r.text)]
    prints = [fingerprint(r.text) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0, rows[i].h))
    place = {i: n for n, i in enumerate(order)}
    first = classes([(place[i], p) for i, p in enumerate(prints)])
    rows = [r for i, r in enumerate(rows) if first[prints[i]] == place[i]]
    return [r for r in rows if not windows(r.text, items)[3]]


def test_stages_on_awkward_rows(spark, tmp_path):
    d = docs(spark)
    items = [(1, " ".join(d.collect()[9].text.split()[200:240])), (2, "zebra")]
    write(d, tmp_path, "documents")
    write(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    at, seen = d, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen.append((name, at.columns, at.collect()))
        at = spark.createDataFrame(seen[-1][2], at.schema)
    assert [s[0] for s in seen] == ["language ID", "near-dedup", "decontamination", "mixing", "sharding"]
    assert all(s[1] == d.columns for s in seen[:-1])
    want = survivors(d.selectExpr("*", "xxhash64(text) h").collect(), items)
    assert Counter((r.doc_id, r.text, r.source) for r in seen[2][2]) == Counter((r.doc_id, r.text, r.source) for r in want)
    mixed, sharded = seen[3][2], seen[4][2]
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in want}
    assert max(Counter((r.doc_id, r.text) for r in mixed).values()) <= 3
    assert Counter((r.doc_id, r.text) for r in mixed) == Counter((r.doc_id, r.text) for r in sharded)
    counts = Counter(r.shard for r in sharded)
    assert max(counts.values()) <= 1 + min([counts.get(s, 0) for s in range(40)])


def test_language_stage_follows_the_network(spark, monkeypatch):
    """Wordless texts with letters go, clean ones stay, and another network keeps other rows."""
    r = random.Random(1)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(r.choices(letters, k=r.randint(3, 9))) for _ in range(500)) for _ in range(8)]
    noise += [base64.b64encode(r.randbytes(4000)).decode() for _ in range(8)]
    both = d.union(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(noise)], d.schema))
    ids = lambda: sorted(x.doc_id for x in stages.identify_language(spark, both, "").collect())
    want = sorted(x.doc_id for x in d.collect())
    assert ids() == want
    fit = language.fit

    def blind(docs):
        net = fit(docs)
        return language.Network(net.labels, {k: v * (k == "out_b") for k, v in net.w.items()})

    monkeypatch.setattr(language, "fit", blind)
    assert ids() != want


def test_least_score_without_enough_to_tell_by(spark):
    d = docs(spark)
    assert language.least_score(d, language.fit(d)) == 0
    assert language.least_score(d, language.Network.fresh(["a"])) == language.least_score(d, language.Network.fresh([])) == 0


def test_empty(spark, tmp_path):
    d = spark.createDataFrame([], DOCS)
    write(d, tmp_path, "documents")
    write(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_on_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "xxhash64(text) h").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = survivors(rows, items)
    got = corpus_pipeline.run(spark, sf).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in want:
        sizes[r.source] += size(r.text)
    aim = targets(sizes)
    taken, longest = Counter(), Counter()
    for r in got:
        taken[r.source] += size(r.text)
    for r in want:
        longest[r.source] = max(longest[r.source], size(r.text))
    assert {r.doc_id for r in got} <= {r.doc_id for r in want}
    assert all(abs(taken[s] - aim[s]) <= 3 * longest[s] + 3 for s in sizes)
    d = spark.createDataFrame([r[:5] for r in want], "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r._mix_copies for r in mixing.mix(d, stages.MIX_SEED).collect()}
    assert Counter(r.doc_id for r in got) == Counter({k: v for k, v in copies.items() if v})


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    class Q:
        run = staticmethod(QUERIES[name])
        sql = SQL[name]

    ok, message, _ = compare(spark, connect(sf), sf, Q)
    assert ok, message


def test_least_score_is_the_quantile_of_all_held_out_documents(spark, monkeypatch):
    """5,000 held-out labelled documents, most of one score: none is left out."""
    d = spark.range(25000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    score = F.when(F.col("doc_id") % 37 == 0, (F.col("doc_id") % 991) / 4000 + 0.3).otherwise(F.lit(0.999))
    monkeypatch.setattr(language, "predict", lambda docs, net: docs.select("doc_id", F.lit("a").alias("lang_pred"), score.alias("score")))
    want = [r.score for r in d.where(language.held_out(F.col("doc_id"))).select(score.alias("score")).collect()]
    assert len(want) > 4000
    got = language.least_score(d, language.Network.fresh(["a", "b"]))
    assert abs(got - (0.5 + 0.25 * (float(np.quantile(want, 0.01)) - 0.5))) < 1e-12
