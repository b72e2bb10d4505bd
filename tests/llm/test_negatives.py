"""Hard negatives against plain loops, and the bounds against every score."""

import math
import random

import numpy as np
import pytest

from kifulake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, tile string, low int"


def expected(data):
    rows = set()
    for i, v, label, *_ in data:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        rows.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for i, label, v in rows:
        if i % 100:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i)
        for s, j, m in [o for o in others if o[2] == label][:5]:
            fit = [o for o in others if o[2] != label and 30 * -s <= 100 * -o[0] <= 90 * -s]
            out += [(i, j, n + 1, o[1], -s, -o[0]) for n, o in enumerate(fit[:10])]
    return sorted(out)


def check(spark, data):
    d = spark.createDataFrame([(*x, "s", "t", 1) for x in data], SCHEMA)
    got = negatives.hard_negatives(d)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == expected(data)


def test_clusters_ties_and_awkward_rows(spark):
    """Tight clusters, equal vectors under several ids, zero vectors, and rows that take no part."""
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    data = [(i, [x + r.gauss(0, 0.2) for x in centres[i % 6]], r.randrange(3)) for i in range(900)]
    data += [(1000 + i, centres[0], i % 4) for i in range(60)]
    data += [(1300, [0.0] * 8, 1), (1301, [0.0] * 8, 2), (1400, None, 1), (1401, centres[1], None), (None, centres[1], 2)]
    data += [(1500, [float("nan")] + [0.0] * 7, 1), (1501, [None] + [1.0] * 7, 1), (1502, [float("inf")] * 8, 1)]
    data += [data[0], data[100], data[100]]
    check(spark, data)


def test_few_and_none(spark):
    check(spark, [(0, [1.0, 0.5], 1)])
    check(spark, [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.25], 3), (3, [0.75, 0.25], 3), (100, [-1.0, 0.0], 1)])
    check(spark, [])


def test_large_components(spark):
    """Scores beyond 2^53 stay exact."""
    r = random.Random(6)
    check(spark, [(i * 5, [float(r.randrange(-(1 << 20), 1 << 20)) for _ in range(4)], r.randrange(2)) for i in range(120)])


def test_scores_that_do_not_fit():
    with pytest.raises(OverflowError):
        negatives.scores(np.full((1, 4), 2.0**40), np.full((1, 4), 2.0**40))


def test_bounds_hold():
    """No score leaves its interval, and the intervals of tight tiles are narrow."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(5, 16))
    v = np.floor(256 * np.concatenate([c + r.normal(size=(40, 16)) * 0.02 for c in centres] + [np.zeros((1, 16))]))
    refs = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    norm = np.linalg.norm(v, axis=1)
    ang = np.arccos(np.clip(v @ refs.T / np.maximum(norm, 1e-300)[:, None], -1, 1))
    narrow = 0
    for i in range(0, len(v), 20):
        t = slice(i, i + 20)
        low, high = negatives.bounds(ang, norm, ang[t].min(axis=0), ang[t].max(axis=0), norm[t].min(), norm[t].max())
        s = v @ v[t].T
        assert (s >= low[:, None]).all() and (s <= high[:, None]).all()
        narrow += int((high - low < 0.2 * norm.max() ** 2).sum())
    assert narrow > 100


def test_tiles_out_of_reach_are_not_scored(monkeypatch):
    """A search for the nearest rows scores few of many far tiles."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(16, 16))
    v = np.floor(256 * np.concatenate([c + r.normal(size=(32, 16)) * 0.01 for c in centres]))
    refs = centres / np.linalg.norm(centres, axis=1, keepdims=True)
    norm = np.linalg.norm(v, axis=1)
    ang = np.arccos(np.clip(v @ refs.T / norm[:, None], -1, 1))
    n = len(v)
    tiles = {"tile": np.arange(n) // 32, "id": np.arange(n), "label": np.zeros(n, int), "v": v, "norm": norm, "angles": ang}
    exact = (v[5] @ v[:32].T).astype(int)
    exact[5] = 0
    anchors = {"id": np.array([5]), "row": np.array([0]), "label": np.array([0]), "v": v[5:6], "norm": norm[5:6], "angles": ang[5:6], "slot": np.array([0])}
    anchors |= {"low": np.array([np.sort(exact)[-5]]), "high": np.array([2**62])}
    calls = []
    plain = negatives.scores
    monkeypatch.setattr(negatives, "scores", lambda a, b: calls.append(len(b)) or plain(a, b))
    found = negatives._search(anchors, tiles, True, 5, 16).to_pandas()
    assert sorted(found["score"], reverse=True)[:5] == sorted(exact, reverse=True)[:5] and len(calls) < 8
