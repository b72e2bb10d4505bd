import random

import pytest
from pyspark.sql import functions as F

from kifulake.operators import checks, games, ordering, surveys


def stream(spark, files):
    rows = [(f, i, p) for f, plies in enumerate(files) for i, p in enumerate(plies)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "file_id int, rec_idx bigint, ply int").repartition(3)


def brute(files):
    out, seq = {}, -1
    for f, plies in enumerate(files):
        prev = None
        for i, p in enumerate(plies):
            if prev is None or p <= prev:
                seq += 1
            out[(f, i)], prev = seq, p
    return out


@pytest.mark.parametrize("block_rows", [1, 2, 3, 7, 1000])
def test_segmentation_across_blocks(spark, block_rows):
    rng = random.Random(block_rows)
    files = [[rng.randrange(6) for _ in range(40)], [], [3], list(range(25))]
    got = games.segment_games(stream(spark, files), block_rows=block_rows)
    assert {(r.file_id, r.rec_idx): r.game_seq for r in got.collect()} == brute(files)


def test_equal_ply_starts_a_game(spark):
    got = games.segment_games(stream(spark, [[5, 9, 5]]))
    assert sorted(r["count"] for r in got.groupBy("game_seq").count().collect()) == [1, 2]


def test_null_ply_is_refused(spark):
    df = stream(spark, [[1, 2]]).withColumn("ply", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="ply"):
        games.segment_games(df).collect()


def test_targets_and_norm(spark):
    df = games.with_game_targets(games.segment_games(stream(spark, [[1, 2, 3, 4, 5], [7]])))
    rows = sorted(df.collect(), key=lambda r: (r.file_id, r.rec_idx))
    assert [r.target for r in rows] == [0, 0.25, 0.5, 0.75, 1, 0]
    two = games.with_game_targets(games.segment_games(stream(spark, [[1, 2, 3, 1, 2, 3]])))
    routed = games.with_position_norm(games.route_games(two, 0.0, 2), 2)
    assert [r.norm for r in routed.collect()] == pytest.approx([1 / 6] * 6)


@pytest.mark.parametrize("fraction,stride", [(0.05, 20), (0.1, 10), (0.25, 4), (0.5, 2), (0.0, None)])
def test_holdout_stride(fraction, stride):
    assert games.holdout_stride(fraction) == stride


@pytest.mark.parametrize("fraction,per_step", [(0.0, 3), (0.25, 3), (0.5, 4), (0.1, 2)])
def test_routing_matches_a_plain_loop(spark, fraction, per_step):
    df = spark.range(23).select(F.col("id").alias("game_seq"), F.lit(2).alias("game_len"))
    got = {r.game_seq: r for r in games.with_position_norm(games.route_games(df, fraction, per_step), per_step).collect()}
    stride, seen = games.holdout_stride(fraction), {True: 0, False: 0}
    sizes = {}
    for g in range(23):
        val = stride is not None and g % stride == 0
        assert got[g].is_val == val and got[g].side_seq == seen[val]
        sizes.setdefault((val, seen[val] // per_step), []).append(g)
        seen[val] += 1
    for (_, _), members in sizes.items():
        for g in members:
            assert got[g].norm == pytest.approx(1 / (2 * len(members)))


@pytest.mark.parametrize("block_rows", [1, 4, 1000])
def test_ordinals(spark, block_rows):
    df = stream(spark, [[0] * 9, [0] * 5, [0]])
    got = ordering.with_ordinal(df, within_file="local", block_rows=block_rows).collect()
    want = [(f, i) for f, n in enumerate((9, 5, 1)) for i in range(n)]
    assert {(r.file_id, r.rec_idx): r.ordinal for r in got} == {k: i for i, k in enumerate(want)}
    assert all(r.local == r.rec_idx for r in got)


def test_strided_sample_caps_across_files(spark):
    df = stream(spark, [[0] * 20, [0] * 20])
    got = checks.strided_sample(df, 1, 3, 9, block_rows=4).collect()
    want = [(f, i) for f in (0, 1) for i in range(1, 20, 3)][:9]
    assert sorted((r.file_id, r.rec_idx) for r in got) == want


def test_fixed_holdout_and_tail(spark):
    df = stream(spark, [[0] * 21])
    assert games.fixed_holdout(df, 10, 4).count() == 12
    assert games.fixed_holdout(df, 100, 4).count() == 20
    with pytest.raises(Exception, match="full batch"):
        games.fixed_holdout(df, 100, 50).collect()
    assert games.tail_split(df, 5).where("split = 'holdout'").count() == 5
    with pytest.raises(Exception, match="no training records"):
        games.tail_split(df, 21).collect()


def test_exact_ranks_match_sorting(spark):
    rng = random.Random(3)
    rows = [("a", abs(rng.gauss(0, 1)) if rng.random() > 0.2 else 0.5) for _ in range(3000)] + [("b", 0.0)] * 7
    df = spark.createDataFrame(rows, "name string, a double")
    got = ordering.select_ranks(df, "name", "a", {"p99": F.floor((F.col("n") - 1) * 0.99), "mid": F.floor((F.col("n") - 1) * 0.5)})
    for r in got.collect():
        values = sorted(v for k, v in rows if k == r.name)
        assert r.p99 == values[int((len(values) - 1) * 0.99)] and r.mid == values[int((len(values) - 1) * 0.5)]


def test_boundary_blocks_alone_are_ordered(spark):
    """Whatever the block size, a prefix or suffix is the same; whole blocks carry no window."""
    rows = spark.range(1000).select((F.col("id") % 3).cast("int").alias("file_id"), F.expr("id div 3").alias("rec_idx"), F.lit(5).alias("score"))
    order = sorted((r.file_id, r.rec_idx) for r in rows.collect())
    for block in (7, 64, 5000):
        tail = {(r.file_id, r.rec_idx): r.split for r in games.tail_split(rows, 130, block_rows=block).collect()}
        assert [tail[k] for k in order] == ["train"] * 870 + ["holdout"] * 130
        got = games.fixed_holdout(rows, 100, 32, block_rows=block).collect()
        assert sorted((r.file_id, r.rec_idx) for r in got) == order[:128]
        assert {(r.file_id, r.rec_idx): r.batch_id for r in got} == {k: i // 32 for i, k in enumerate(order[:128])}
    with pytest.raises(Exception, match="no training records"):
        games.tail_split(rows, 1000).collect()


def _side(spark, rows):
    return spark.createDataFrame(rows, "k long, score int, result int")


def test_crosscheck_by_block_digests(spark):
    left = [(i, i % 7, None if i % 5 == 0 else i % 3) for i in range(400)] + [(None, 1, 1), (-3, 2, 2)]
    right = [(k, s, r) for k, s, r in left if k is None or k % 50 != 9]
    right = [(k, s + 1 if k == 130 else s, 0 if k in (140, 145) else r) for k, s, r in right] + [(900, 1, 1), (-2, 2, 2)]
    mine = {k: (s, r) for k, s, r in left if k is not None}
    other = {k: (s, r) for k, s, r in right if k is not None}
    both = mine.keys() & other.keys()
    want = {
        "n_left": len(left), "n_right": len(right), "only_left": len(mine.keys() - other.keys()) + 1, "only_right": len(other.keys() - mine.keys()) + 1,
        "diff_score": sum(mine[k][0] != other[k][0] for k in both), "diff_result": sum(mine[k][1] != other[k][1] for k in both),
    }
    for sent in (0, 100):
        got = checks.crosscheck(_side(spark, left), _side(spark, right), "k", ["score", "result"], block_rows=16, sent=sent)
        assert got.first().asDict() == want
    empty = checks.crosscheck(_side(spark, []), _side(spark, []), "k", ["score"]).first()
    assert (empty.n_left, empty.n_right, empty.only_left, empty.diff_score) == (0, 0, 0, 0)


def test_equal_blocks_are_not_shuffled(spark):
    left = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("score"))
    right = left.withColumn("score", F.when(F.col("k") == 517, 2).otherwise(1))
    blocks = checks.block_differences(left, right, "k", ["score"], 100)
    apart = blocks.where("not same")
    assert [r.block for r in apart.collect()] == [5] and blocks.count() == 10
    kept = checks.differing_records(left, spark.createDataFrame(apart.collect(), apart.schema), "k", 100)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastExchange" in plan
    assert sorted(r.k for r in kept.collect()) == list(range(500, 600))
    nulls = checks.block_differences(_side(spark, [(1, None, 1)]), _side(spark, [(1, 1, None)]), "k", ["score", "result"], 100)
    assert not nulls.first().same  # a null in another field is another record


@pytest.mark.parametrize("block", [1, 3, 64])
def test_cumulative_snapshots_match_sorting(spark, block):
    rnd = random.Random(5)
    rows = [(rnd.randrange(9) * 2, None if rnd.random() < 0.1 else rnd.randrange(30)) for _ in range(500)] + [(None, 3)]
    df = spark.createDataFrame(rows, "sb int, v int")
    snapshots = surveys.cumulative_snapshots(df, "sb", "v", block=block)
    assert "NestedLoop" not in snapshots._jdf.queryExecution().executedPlan().toString()
    got = {r.superbatch: tuple(r)[1:] for r in snapshots.collect()}
    want = {}
    for sb in sorted({s for s, v in rows if s is not None and v is not None}):
        seen = sorted(v for s, v in rows if s is not None and s <= sb and v is not None)
        at = lambda p: seen[-(-len(seen) * p // 100) - 1]  # noqa: E731, B023
        want[sb] = (len(seen), pytest.approx(sum(seen) / len(seen)), at(50), at(90), at(99), seen[-1])
    assert got == want
    assert surveys.cumulative_snapshots(df.where("false"), "sb", "v").count() == 0
