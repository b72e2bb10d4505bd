"""The network's gradients, and accuracy on documents it has not seen."""

import zlib

import numpy as np
import pyarrow as pa
from rows import DOCS, docs

from kifulake.llm import language
from kifulake.llm.queries import QUERIES


def test_gradients_match_differences():
    net = language.Network.fresh(["a", "b", "c"], seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(2)
    x, y, w = r.integers(97, 103, (7, 5)).astype(np.uint8), r.integers(0, 3, 7), r.random(7)

    def loss():
        p = net.positions(x)
        return -(np.log(p[:, np.arange(7), y]) * w).sum() / (w.sum() * 5)

    grad = net.gradients(x, y, w)
    for name, g in grad.items():
        flat = net.w[name].reshape(-1)
        used = np.flatnonzero(np.abs(g).reshape(-1) > 1e-5)
        for i in used[:: max(1, len(used) // 6)]:
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[i]) < 2e-3, name


def test_pooling_is_the_mean_over_positions():
    """Distinct segments run once give what every segment run by itself gives, long runs included."""
    net = language.Network.fresh(["a", "b"], seed=4)
    texts = ["Ab ab, ab!", "", "é" * 50 + " x", None, "12 34"]
    best, score = language.Labeller(net).pooled(pa.array(texts))
    for i, t in enumerate(texts):
        folded = bytes(language.FOLD[list((t or "").encode())])
        runs = "".join(chr(b) if language.LETTER[b] else " " for b in folded).split(" ")
        runs = [r.encode("latin1") for r in runs if r]
        pieces = [r[k : k + 32] for r in runs for k in range(0, len(r), 32)]
        if not pieces:
            assert (best[i], score[i]) == (-1, 0)
            continue
        sums = sum(net.positions(np.frombuffer(p, np.uint8)[None]).sum(axis=(0, 1)).astype(float) for p in pieces)
        mean = sums / sum(map(len, pieces))
        assert best[i] == mean.argmax() and abs(score[i] - mean.max()) < 1e-5


def test_awkward(spark):
    d = docs(spark)
    net = language.fit(d)
    rows = {(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in language.predict(d, net).collect()}
    assert all(r[2] for r in rows)
    said = {r.doc_id: r.lang_pred for r in language.predict(d, net).collect()}
    for r in d.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert said[r.doc_id] == "und"
        else:
            assert said[r.doc_id] in net.labels
    kept = language.keep_identified(d, net, 0.0)
    assert kept.schema == d.schema
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in d.collect() if r.text and any(c.isalpha() for c in r.text))


def test_empty(spark):
    d = spark.createDataFrame([], DOCS)
    net = language.fit(d)
    assert net.labels == [] and language.predict(d, net).count() == 0
    assert {r.lang_pred for r in language.predict(docs(spark), net).collect()} == {"und"}
    kept = language.keep_identified(docs(spark), net, 0.0).collect()
    assert kept and all(any(c.isalpha() for c in r.text) for r in kept)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op1_language_gru"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in unseen) >= 0.98 * len(unseen)
