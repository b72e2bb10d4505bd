import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kifulake.operators import features, inference, losses, metrics, progress, runs, surveys, tensors
from kifulake.plans import adapters as ad


def test_training_equals_a_plain_loop(spark, sf):
    """Distributed training against the same steps on one machine."""
    pos = ad.v_board(spark, sf).where("pos_id < 200")
    w, log = progress.progress_train(pos, epochs=2, games_per_step=40, fraction=0.25, lr=0.01)
    rows = progress.training_table(pos, 0.25, 40).collect()
    train = [r for r in rows if not r.is_val]
    want, m, v, t = np.zeros(progress.N_WEIGHTS), np.zeros(progress.N_WEIGHTS), np.zeros(progress.N_WEIGHTS), 0
    lr = 0.01 * math.sqrt(40)
    for _ in range(2):
        for step in range(max(r.step_id for r in train) + 1):
            g = np.zeros_like(want)
            for r in (r for r in train if r.step_id == step):
                p = 1 / (1 + math.exp(-sum(want[i] for i in r.idx)))
                for i in r.idx:
                    g[i] += 2 * (p - r.target) * p * (1 - p) * r.norm
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            want = want - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(w, want, atol=1e-9)
    assert len(log) == 2 and log[0]["train_samples"] == len(train) and log[0]["val_samples"] == len(rows) - len(train)


def test_files_of_a_step_do_not_grow_with_the_steps(spark, sf):
    """The training table has files by write tasks; a step opens a constant number of them."""
    pos = ad.v_board(spark, sf).where("pos_id < 600")
    stores = [progress.store_steps(progress.training_table(pos, 0.25, per)) for per in (100, 5)]
    steps = [s.last_step() + 1 for s in stores]
    assert steps[1] >= 8 * steps[0]
    files = [{p for p, *_ in s.spans} for s in stores]
    most = [max(len(s.files(False, i)) for i in range(n)) for s, n in zip(stores, steps, strict=True)]
    assert len(files[1]) <= len(files[0]) + 1 and most[1] <= most[0] <= 5
    for s, n in zip(stores, steps, strict=True):
        every = s.read(False).groupBy("step_id").count().collect()
        assert {r.step_id: r["count"] for r in every} == {i: s.read(False, i).count() for i in range(n)}


@pytest.mark.parametrize("save_every", [0, 1])
def test_a_stopped_training_goes_on(spark, sf, tmp_path, monkeypatch, save_every):
    """Stopped in the middle of the second epoch, a training ends with the weights of an unbroken one."""
    pos, path = ad.v_board(spark, sf).where("pos_id < 120"), str(tmp_path / "state")
    args = {"epochs": 2, "games_per_step": 10, "lr": 0.01}
    want, log = progress.progress_train(pos, **args)
    plain, calls = progress.step_gradient, []
    steps = progress.store_steps(progress.training_table(pos, 0.0, 10)).last_step() + 1
    assert steps > 2

    def stopping(*a):
        calls.append(1)
        if len(calls) == steps + 2:
            raise KeyboardInterrupt
        return plain(*a)

    monkeypatch.setattr(progress, "step_gradient", stopping)
    with pytest.raises(KeyboardInterrupt):
        progress.progress_train(pos, **args, state_path=path, save_every=save_every)
    monkeypatch.setattr(progress, "step_gradient", plain)
    found = progress.load_state(spark, path)
    assert (found.epoch, found.step, found.t) == (2, save_every, steps + save_every)
    got, rest = progress.progress_train(pos, **args, state_path=path, save_every=save_every)
    assert np.allclose(got, want, atol=1e-12) and rest[-1]["train_samples"] == log[-1]["train_samples"]
    assert rest[-1]["train_loss"] == pytest.approx(log[-1]["train_loss"]) and len(rest) == 1
    assert progress.progress_train(pos, **args, state_path=path)[1] == []  # nothing left to do


def test_many_small_steps_are_taken_in_runs(spark, sf):
    """Fewer jobs than steps, and the weights of the same steps one by one on one machine."""
    pos = ad.v_board(spark, sf).where("pos_id < 500")
    table = progress.training_table(pos, 0.25, 2).orderBy("step_id", "pos_id").toArrow()
    train = [r for r in table.to_pylist() if not r["is_val"]]
    steps = max(r["step_id"] for r in train) + 1
    spark.sparkContext.setJobGroup("runs", "runs")
    w, log = progress.progress_train(pos, epochs=2, games_per_step=2, fraction=0.25, lr=0.01)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("runs")
    spark.sparkContext.setJobGroup("after", "after")
    assert steps > 50 and len(jobs) < steps
    state, losses = progress.TrainState.start(), []
    for _ in range(2):
        for step in range(steps):
            g = np.zeros(progress.N_WEIGHTS)
            for r in (r for r in train if r["step_id"] == step):
                p = 1 / (1 + math.exp(-sum(state.w[i] for i in r["idx"])))
                losses.append((p - r["target"]) ** 2)
                np.add.at(g, r["idx"], 2 * (p - r["target"]) * p * (1 - p) * r["norm"])
            state.take(g, 0.01 * math.sqrt(2))
    assert np.allclose(w, state.w, atol=1e-9)
    assert [r["train_samples"] for r in log] == [len(train)] * 2 and log[0]["val_samples"] == table.num_rows - len(train) == sum(log[0]["val_hist"])
    assert log[1]["train_loss"] == pytest.approx(np.mean(losses[len(train) :]))


def test_a_training_stopped_within_a_run_goes_on(spark, sf, tmp_path, monkeypatch):
    pos, path = ad.v_board(spark, sf).where("pos_id < 200"), str(tmp_path / "state")
    args = {"epochs": 1, "games_per_step": 2, "lr": 0.01}
    want, log = progress.progress_train(pos, **args)
    plain, stops = progress.SmallSteps.take, []

    def stopping(small, state, stop, rate):
        stops.append(stop)
        if len(stops) == 5:
            raise KeyboardInterrupt
        return plain(small, state, stop, rate)

    monkeypatch.setattr(progress.SmallSteps, "take", stopping)
    with pytest.raises(KeyboardInterrupt):
        progress.progress_train(pos, **args, state_path=path, save_every=7)
    monkeypatch.setattr(progress.SmallSteps, "take", plain)
    assert 7 in stops and any(0 < s < 7 for s in stops) and progress.load_state(spark, path).step % 7 == 0
    got, rest = progress.progress_train(pos, **args, state_path=path)
    assert np.allclose(got, want, atol=1e-12) and rest[0]["train_samples"] == log[0]["train_samples"]


def test_steps_without_both_kings_still_count(spark, sf):
    """A step whose positions all lack a king moves the weights by its decaying moments alone; at the end there is none."""
    board = ad.v_board(spark, sf).where("pos_id < 200")
    labels = {r.pos_id: r.step_id for r in progress.game_labels(board, 0.0, 2).select("pos_id", "step_id").collect()}
    last = max(labels.values())
    gone = [p for p, step in labels.items() if step in (5, 6, last)]
    pos = board.withColumn("bk_sq", F.when(~F.col("pos_id").isin(gone), F.col("bk_sq")))
    table = progress.training_table(pos, 0.0, 2).toArrow().to_pylist()
    assert last > 20 and max(r["step_id"] for r in table) == last - 1
    w, log = progress.progress_train(pos, epochs=1, games_per_step=2, lr=0.01)
    state = progress.TrainState.start()
    for step in range(last):
        g = np.zeros(progress.N_WEIGHTS)
        for r in (r for r in table if r["step_id"] == step):
            p = 1 / (1 + math.exp(-sum(state.w[i] for i in r["idx"])))
            np.add.at(g, r["idx"], 2 * (p - r["target"]) * p * (1 - p) * r["norm"])
        state.take(g, 0.01 * math.sqrt(2))
    assert log[0]["train_samples"] == len(table) and np.allclose(w, state.w, atol=1e-9)


def test_training_starts_from_a_stored_table(spark, sf, tmp_path):
    from kifulake.sources import documents

    pos, path = ad.v_board(spark, sf).where("pos_id < 60"), str(tmp_path / "epochs")
    w, _ = progress.progress_train(pos, epochs=2, games_per_step=1000, on_epoch=progress.store_epochs(spark, path))
    stored = documents.final_weights(spark, path)
    assert np.allclose(progress.start_weights(stored), w, atol=1e-7)
    with pytest.raises(ValueError, match="weights"):
        progress.start_weights(stored.limit(5))


def test_zero_weights_score_half(spark, sf):
    f = features.kp_progress_features(ad.v_board(spark, sf), ["pos_id"])
    p = progress.progress_score(f, spark.createDataFrame([], "idx int, w double")).select("p").distinct().collect()
    assert [r.p for r in p] == [0.5]
    assert spark.range(1).select(progress.progress_bucket(F.lit(0.5), 9).alias("b")).first().b == 4


def plain_forward(net, stm, nstm, b):
    half = lambda a: [min(max((min(max(int(x), 0), 127) * min(max(int(y), 0), 127)) >> 7, 0), 126) for x, y in zip(a[: len(a) // 2], a[len(a) // 2 :])]
    acc = lambda ids: [int(net.ft_b[k] + sum(net.ft[i][k] for i in ids)) for k in range(net.ft.shape[1])]
    x = half(acc(stm)) + half(acc(nstm))
    one = [int(net.l1_b[b][o]) + sum(a * int(w) for a, w in zip(x, net.l1[b][o])) for o in range(net.l1.shape[1])]
    main = one[:-1]
    two_in = [min((v * v) >> 19, 127) for v in main] + [min(max(v >> 6, 0), 127) for v in main]
    two = [int(net.l2_b[b][o]) + sum(a * int(w) for a, w in zip(two_in, net.l2[b][o])) for o in range(net.l2.shape[1])]
    act = [min(max(v >> 6, 0), 127) for v in two]
    return int(net.l3_b[b]) + sum(a * int(w) for a, w in zip(act, net.l3[b])) + one[-1]


def test_batch_scores_equal_integer_loops(spark, sf):
    rng = np.random.default_rng(5)
    n_ft, width = features.FEATURE_SETS["halfkp"].ft_in, 8
    t = {"ft_w": rng.normal(0, 0.2, n_ft * width), "ft_b": rng.normal(0.2, 0.2, width), "l1_w": rng.normal(0, 1, 9 * 3 * width), "l1_b": rng.normal(0, 1, 27),
         "l2_w": rng.normal(0, 1, 9 * 4 * 4), "l2_b": rng.normal(0, 1, 36), "l3_w": rng.normal(0, 1, 36), "l3_b": rng.normal(0, 1, 9)}
    net = inference.Net.from_tensors(t, width, 9)
    pos = progress.bucket_assign(ad.v_board(spark, sf).where("pos_id < 60"), "kingrank9")
    got = {r.pos_id: r for r in inference.batch_score_positions(pos, net, "halfkp", 16).collect()}
    buckets = {r.pos_id: r.bucket for r in pos.collect()}
    ids = {}
    for r in features.half_features(pos, "halfkp", ["pos_id"]).collect():
        ids.setdefault(r.pos_id, ([], []))
        ids[r.pos_id][0].append(r.stm_idx)
        ids[r.pos_id][1].append(r.nstm_idx)
    assert len(got) == 60
    for k, (s, n) in ids.items():
        assert got[k].raw == plain_forward(net, s, n, buckets[k])
        assert got[k].cp == got[k].raw / 16


def test_loss_parameters_are_checked():
    for bad in ({"power": 0.5}, {"boost_w1": -1}, {"asymmetry": -0.1}, {"in_scaling": 0}, {"blend": 2}, {"to_score": math.nan}):
        with pytest.raises(ValueError):
            losses.WinRateLoss(**bad)


def test_general_loss_with_plain_parameters_is_the_plain_loss(spark):
    df = spark.createDataFrame([(0.3, 150, 1.0, 1.0), (-0.2, -40, 0.5, 1.0), (0.1, 900, 0.0, 1.0)], "out double, score int, wdl double, norm double")
    k = losses.WinRateLoss()
    plain = losses.win_rate_loss(df, k).agg(F.avg("sq_err").alias("m")).first().m
    assert losses.general_loss(df, k).first().mean_loss == pytest.approx(plain)


def test_accuracy_without_decided_games_is_nan(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.0)], "out double, wdl double, sq_err double")
    row = metrics.holdout_report(df).first()
    assert math.isnan(row.accuracy) and row.n_counted == 0


def test_histogram_ties_and_empty(spark):
    df = spark.createDataFrame([(2,), (2,), (1,), (1,)], "bucket int")
    h = surveys.bucket_histogram(df, 4).orderBy("bucket").collect()
    assert [r.n for r in h] == [0, 2, 2, 0] and [r.bucket for r in h if r.is_top] == [1]
    none = surveys.bucket_histogram(df.where("bucket > 9"), 4).orderBy("bucket").collect()
    assert [(r.bucket, r.pct) for r in none if r.is_top] == [(0, 0.0)]


def test_run_best_ignores_bad_losses(spark):
    rows = [("r", 1, 0.5, 0.9), ("r", 2, float("nan"), float("inf")), ("r", 3, 0.5, 0.9), ("s", 1, float("nan"), None)]
    h = runs.recorded_history(spark.createDataFrame(rows, "run string, superbatch int, loss double, test_loss double"))
    assert sorted(r.recorded_loss for r in h.where("run = 'r'").collect()) == [0.0, 0.5, 0.5]
    best = {r.run: r for r in runs.run_best(h).collect()}
    assert (best["r"].best_loss, best["r"].best_loss_superbatch, best["r"].best_test_loss_superbatch) == (0.5, 1, 1)
    assert best["s"].best_loss is None and best["s"].best_test_loss is None


def test_benchmark_statistics(spark):
    rows = [("c", i, 2, v) for i, v in enumerate([1.0, 2.0, 4.0, 5.0])] + [("c", 0, 1, 99.0), ("d", 0, 2, 3.0)]
    out = {r.case_id: r for r in runs.bench_summary(spark.createDataFrame(rows, "case_id string, run int, superbatch int, pos_per_sec double"), 1).collect()}
    c = out["c"]
    assert (c.mean, c.median, c.min, c.max) == (3, 3, 1, 5) and c.sample_sd == pytest.approx(1.8257418583505538)
    assert out["d"].sample_sd == 0


def test_tensor_diff_edges(spark):
    mk = lambda rows: spark.createDataFrame(rows, "name string, idx bigint, v double")
    a, b = mk([("z", 0, 0.0), ("h", 0, 0.0), ("u", 0, 1.0)]), mk([("z", 0, 0.0), ("h", 0, 2.0), ("u", 0, 1.0), ("u", 1, 1.0)])
    got = {r.name: r for r in tensors.tensor_diff(a, b, strict=False).collect()}
    assert (got["z"].cosine, got["h"].cosine, got["u"].n_unmatched) == (1.0, 0.0, 1)
    with pytest.raises(Exception, match="length mismatch"):
        tensors.tensor_diff(a, b).collect()


def test_quantised_rounds_half_away(spark):
    v = spark.createDataFrame([(x,) for x in (0.5 / 64, -0.5 / 64, 5.0, -5.0)], "v double")
    assert [r.q for r in v.select(tensors.quantise(F.col("v"), 64.0, -128, 127).alias("q")).collect()] == [1, -1, 127, -128]


def test_ablation_report(spark):
    t = spark.range(216_720).select(F.col("id").alias("idx"), F.lit("t").alias("name"), F.lit(2.0).alias("v"))
    r = {x.spec: x for x in tensors.ablation_report(t, 1, "full").collect()}
    assert r["all"].dims == r["all"].n_values == 216720 and r["all"].pairs == 324 and r["all"].l2sq == 4.0 * 216720
    assert r["attack"].pairs == r["defense"].pairs == 162 and r["same-class"].pairs == 36
    assert r["slider-attacker"].dims + r["step-attacker"].dims == 216720


@pytest.mark.parametrize("call", [
    lambda t: tensors.pair_norm_breakdown(t, 1, "full"), lambda t: tensors.ablate_rows(t, 1, "full", "all"), lambda t: tensors.ablation_report(t, 1, "full"),
])
def test_rows_outside_the_profile_fail(spark, call):
    t = spark.range(216_721).select(F.col("id").alias("idx"), F.lit("t").alias("name"), F.lit(1.0).alias("v"))
    with pytest.raises(Exception, match="outside profile"):
        call(t).collect()


def test_material_table(spark):
    t = features.material_table(spark, "halfkp", 2, 600.0)
    assert t.count() == 2 * features.FEATURE_SETS["halfkp"].ft_in
    assert t.where("feature = 1").first().value == pytest.approx(100 / 600)
    assert t.where("feature = 171").first().value == pytest.approx(-100 / 600)
