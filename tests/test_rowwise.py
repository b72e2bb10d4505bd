"""Board queries work row by row: no features or edges are regrouped, and tasks hold a bounded number of rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kifulake.operators import boards, edges, features, progress
from kifulake.plans import adapters as ad
from kifulake.plans.catalog import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_material_table_sends_the_fixed_table(spark, sf):
    """The planner takes the exploded features for the smaller side and would gather them on the driver."""
    plan = plan_of(QUERIES["material_table"].run(spark, sf))
    assert "BuildRight" in plan and "BuildLeft" not in plan


@pytest.mark.parametrize("name", ["half_features", "kp_progress_features", "edge_feature_index", "edge_feature_index_dedup", "effect_bucket_features", "batch_score_positions", "batch_score_with_edges"])
def test_ids_are_not_regrouped(spark, sf, name):
    plan = plan_of(QUERIES[name].run(spark, sf))
    assert "hashpartitioning" not in plan and "Generate" not in plan


def test_tasks_hold_a_bounded_number_of_rows(spark, sf, monkeypatch):
    import kifulake.session as session

    events = ad.table(spark, sf, "events")
    size = session.input_bytes(events)
    assert session.task_count(events, size // 40) >= 40
    monkeypatch.setattr(ad, "task_count", lambda df: session.task_count(df, session.input_bytes(df) // 40))
    for ranged in (False, True):
        assert ad.v_board(spark, sf, ranged=ranged).rdd.getNumPartitions() >= 40


def test_used_ids_are_the_distinct_ones(spark, sf):
    names = ["halfkp", "halfka-hm-merged"]
    got = features.used_ids(ad.v_board(spark, sf), names)
    want = features.half_features_of(ad.v_board(spark, sf), names, []).select("feature_set", F.col("stm_idx").alias("idx")).distinct()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_dead_edges_are_matched_within_the_row(spark, sf):
    board = ad.v_board(spark, sf)
    flagged = edges.canonical_dead_edge(edges.mutual_edge_flag(edges.attack_edges(board, ["pos_id"])))
    got = edges.dead_edge_counts(board, ["pos_id"])
    assert got.agg(F.sum("n_dead"), F.sum("n_unmatched")).first() == (flagged.where("dead").count(), edges.edge_violations(flagged).count())


def test_boards_score_as_their_feature_rows(spark, sf):
    board = ad.v_board(spark, sf).where("pos_id < 300")
    rng = np.random.default_rng(1)
    w = rng.normal(size=progress.N_WEIGHTS)
    rows = features.kp_progress_features(board, ["pos_id"])
    want = {r.pos_id: r.p for r in progress.progress_score(rows, progress.weight_table(spark, w, exact=True)).collect()}
    got = {r.pos_id: r.p for r in progress.score_boards(board, progress.weight_sums(progress.weight_table(spark, w, exact=True))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_rows_without_boards(spark, sf):
    """Positions whose board is unknown have no ids, and no other row's."""
    board = ad.v_board(spark, sf).where("pos_id < 20").repartition(1)
    gone = board.withColumn("board", F.when(F.col("pos_id") % 2 == 0, F.col("board")))
    ids = lambda df: {r.pos_id: sorted(r.idx) for r in features.with_kp_ids(df).select("pos_id", "idx").collect()}
    whole, part = ids(board), ids(gone)
    assert all(part[k] == whole[k] for k in whole if k % 2 == 0)
    text = {r.pos_id: r.sfen_text for r in boards.to_sfen(gone).collect()}
    assert all(text[k][0] == " " for k in text if k % 2)  # no board in front


def test_small_steps_are_taken_without_reading_files(spark, sf, monkeypatch):
    pos = ad.v_board(spark, sf).where("pos_id < 200")
    args = {"epochs": 2, "games_per_step": 40, "fraction": 0.25, "lr": 0.01}
    taken = []
    whole = progress.step_gradient
    monkeypatch.setattr(progress, "step_gradient", lambda rows, w: taken.append(type(rows).__name__) or whole(rows, w))
    small, log = progress.progress_train(pos, **args)
    assert len(taken) > 2 and taken.count("SmallStep") == len(taken) - 2  # the validation side, once an epoch
    monkeypatch.setattr(progress, "SMALL_STEP", 0)
    large, other = progress.progress_train(pos, **args)
    assert np.allclose(small, large, rtol=1e-9, atol=1e-12) and abs(log[1]["train_loss"] - other[1]["train_loss"]) < 1e-12


def test_scores_add_up_in_the_order_asked_for(spark):
    """A text on the edge of a bin falls where the sum in text order falls."""
    words = [(d, i, t) for d, text in ((1, "big one small"), (2, "one big small"), (3, "one one none")) for i, t in enumerate(text.split())]
    f = spark.createDataFrame(words, "pos_id bigint, place int, token string").orderBy(F.desc("place"))
    w = spark.createDataFrame([("big", 1e16), ("one", 3.0), ("small", -1e16)], "token string, w double")
    got = {r.pos_id: r.p for r in progress.progress_score(f, w, "token", place="place").collect()}
    z = {1: 1e16 + 3.0 - 1e16, 2: 3.0 + 1e16 - 1e16, 3: 6.0}
    assert all(abs(got[k] - 1 / (1 + np.exp(-z[k]))) < 1e-12 for k in z)


def test_cancelling_texts_fall_in_the_bin_of_their_sum_in_order(spark, tmp_path):
    """Weights 2.3, 1.0 and eleven of -0.3 add up to zero, in doubles to a little more or less by their order."""
    import random

    import duckdb

    words, rng = ["x" * 27, "y" * 14, *"abcdefghijk"], random.Random(1)
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(len(texts)).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    q = QUERIES["progress_eval"]
    got = q.run(spark, str(tmp_path)).first()
    want = con.execute(q.sql)
    want = dict(zip([d[0] for d in want.description], want.fetchone()))
    assert min(want["h3"], want["h4"]) > 0 and {k: v for k, v in got.asDict().items() if k[0] == "h"} == {k: v for k, v in want.items() if k[0] == "h"}


@pytest.mark.parametrize("name", ["progress_score", "progress_bucket", "progress_gradient", "progress_eval", "adam_step"])
def test_weights_meet_blocks_not_single_positions(spark, sf, name):
    """No shuffle carries a row per position and token: that is many times the texts."""
    plan = QUERIES[name].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"Aggregate \[pos_id#\d+L?, token", plan)


ODD_ROWS = [(1, ["a", "b", "a"]), (1, ["c"]), (2, ["a", None, "no"]), (3, []), (4, None), (5, ["b"]), (None, ["b"]), (6, ["only"])]
ODD_WEIGHTS = [("a", 0.5), ("a", 0.25), ("b", -2.0), ("c", None), ("only", 1.0)]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_block_scores_and_gradients_equal_loops(spark, monkeypatch, block):
    """Positions of several rows, or none, of empty arrays; features unknown, null or listed twice; targets null, missing or given twice."""
    monkeypatch.setattr(progress, "BLOCK_BYTES", block)
    w = spark.createDataFrame(ODD_WEIGHTS, "token string, w double")
    plain = spark.createDataFrame(ODD_ROWS, "pos_id bigint, token array<string>")
    rows = progress.in_blocks(plain, F.size("token"))
    total = {t: sum(x for k, x in ODD_WEIGHTS if k == t and x is not None) for t, _ in ODD_WEIGHTS}
    z = {}
    for pos, tokens in ODD_ROWS:
        z[pos] = z.get(pos, 0.0) + sum(total.get(t, 0.0) for t in tokens or ())
    p = {k: 1 / (1 + np.exp(-v)) for k, v in z.items()}
    got = progress.score_rows(rows, w, "token").collect()
    assert len(got) == len(p) and all(abs(r.p - p[r.pos_id]) < 1e-12 for r in got)

    targets = [(1, 1.0, 0.5), (1, 0.0, 2.0), (2, 0.0, 1.0), (3, 1.0, 1.0), (6, None, 1.0)]
    lists = progress.target_lists(spark.createDataFrame(targets, "pos_id bigint, target double, norm double"))
    want = {}
    for pos, tokens in ODD_ROWS:
        for t in tokens or ():
            for at, y, norm in targets:
                if at == pos:
                    g = want.setdefault(t, None)
                    want[t] = g if y is None else (g or 0.0) + 2 * (p[pos] - y) * p[pos] * (1 - p[pos]) * norm
    found = progress.row_gradient(progress.in_blocks(plain.join(lists, "pos_id"), F.size("token")), w, "token").collect()
    found = {r.token: r.g for r in found}
    assert found.keys() == want.keys() and found["only"] is None
    assert all(abs(found[k] - g) < 1e-12 for k, g in want.items() if g is not None)


def test_a_block_asks_for_a_feature_once(spark, monkeypatch):
    f = spark.range(500).select(F.col("id").alias("pos_id"), F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 5)).alias("token"))
    monkeypatch.setattr(progress, "BLOCK_BYTES", 1 << 20)
    rows = progress.in_blocks(f, F.size("token"))
    w = spark.createDataFrame([("the", 1.0), *[(f"w{i}", float(i)) for i in range(5)]], "token string, w double")
    blocks = rows.select("_block").distinct().count()
    assert 6 <= progress.block_weights(rows, w, "token").count() <= 6 * blocks < 100
    monkeypatch.setattr(progress, "BLOCK_BYTES", 10)
    assert progress.in_blocks(f, F.size("token")).select("_block").distinct().count() > 4 * blocks
