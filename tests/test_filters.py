import math

import pytest
from pyspark.sql import functions as F

from kifulake.functions import hashing, scores, squares
from kifulake.operators import filters

M64 = (1 << 64) - 1
BANDS = filters.parse_bands("1500:1.0,3000:0.3,inf:0.1")


def plain_draw(seed, index, epoch):
    """The sampling hash on Python integers."""
    v = seed ^ (index * hashing.INDEX_MULTIPLIER & M64) ^ (epoch * hashing.EPOCH_MULTIPLIER & M64)
    v = (v + hashing.GAMMA) & M64
    v = ((v ^ v >> 30) * hashing.MIX_1) & M64
    v = ((v ^ v >> 27) * hashing.MIX_2) & M64
    return (v ^ v >> 31) >> 40


def scored(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "rec_idx bigint, score int")


def test_draw_equals_integer_arithmetic(spark):
    ids = [0, 1, 2, 12345, 2**31, 2**40 + 7, 2**62 + 3]
    df = hashing.with_unit24(spark.createDataFrame([(i,) for i in ids], "rec_idx bigint"), "rec_idx", 42, 3)
    assert {r.rec_idx: r.u24 for r in df.collect()} == {i: plain_draw(42, i, 3) for i in ids}


def test_drop_then_clamp(spark):
    df = scored(spark, [0, 50, -50, 200, -200, 32000, -32000])
    out = filters.score_clamp(filters.score_drop(df, 32000), 100)
    assert sorted(r.score for r in out.collect()) == [-100, -50, 0, 50, 100]


def test_most_negative_score_has_a_magnitude(spark):
    df = spark.createDataFrame([(-32768,)], "score int").select(F.col("score").cast("smallint").alias("score"))
    assert filters.score_drop(df, 32000).count() == 0


def test_band_edges_and_weights(spark):
    df = scored(spark, [1500, 1501, 3000, 3001, -3001, 32000])
    rows = df.select(filters.importance_weight(F.col("score"), BANDS, 0.5).alias("w")).collect()
    want = [1, math.sqrt(1 / 0.3), math.sqrt(1 / 0.3), math.sqrt(10), math.sqrt(10), math.sqrt(10)]
    assert [r.w for r in rows] == pytest.approx(want, rel=1e-6)


def test_mate_stamp_takes_the_last_band(spark):
    bands = filters.parse_bands("31000:0.8,inf:0.1")
    rows = scored(spark, [31000, 32000]).select(filters.importance_weight(F.col("score"), bands, 1.0).alias("w")).collect()
    assert [r.w for r in rows] == pytest.approx([1.25, 10], rel=1e-6)


@pytest.mark.parametrize("score,rate,tolerance", [(1000, 1.0, 0), (2000, 0.3, 0.003), (4000, 0.1, 0.002)])
def test_keep_rate(spark, score, rate, tolerance):
    df = spark.range(500_000).select(F.col("id").alias("rec_idx"), F.lit(score).alias("score"))
    assert filters.band_sample(df, BANDS, 42, 3).count() / 500_000 == pytest.approx(rate, abs=tolerance)


def test_sampling_is_reproducible(spark):
    df = spark.range(2000).select(F.col("id").alias("rec_idx"), F.lit(2000).alias("score"))
    kept = lambda seed, epoch: {r.rec_idx for r in filters.band_sample(df, BANDS, seed, epoch).collect()}
    assert kept(1234, 0) == kept(1234, 0)
    assert kept(1234, 0) != kept(1235, 0)
    assert kept(1234, 0) != kept(1234, 1)


@pytest.mark.parametrize("text", ["", "100:1.0", "inf:0.1,100:1", "300:1,200:1,inf:1", "100:0,inf:1", "100:1.5,inf:1", "a:1,inf:1", "100,inf:1", "inf:nan"])
def test_bad_bands_are_refused(spark, text):
    with pytest.raises(ValueError):
        filters.parse_bands(text)
    table = filters.band_table(spark.createDataFrame([(text,)], "spec string"))
    assert not any(r.valid for r in table.collect())


def test_empty_source_is_an_error(spark):
    empty = scored(spark, [1]).where("score > 5")
    with pytest.raises(filters.EmptySourceError):
        filters.require_rows(empty, "test")
    with pytest.raises(Exception, match="no usable rows"):
        filters.guarded_count(empty, "test").collect()


def test_fnv(spark):
    row = spark.range(1).select(hashing.fnv1a32(F.lit("a")).alias("a"), hashing.fnv1a32(F.lit("foobar")).alias("f"), hashing.fnv1a32(F.lit("")).alias("e")).first()
    assert (row.a, row.f, row.e) == (0xE40C292C, 0xBF9CF968, 0x811C9DC5)


def test_square_involutions(spark):
    sq = F.col("id").cast("int")
    rows = spark.range(81).select(
        sq.alias("s"), squares.inverse(squares.inverse(sq)).alias("i"), squares.mirror_file(squares.mirror_file(sq)).alias("m"),
        squares.viewed_by(sq, F.lit(1), F.lit(True)).alias("v"),
    ).collect()
    assert all(r.s == r.i == r.m for r in rows)
    assert all(r.v == (8 - (80 - r.s) // 9) * 9 + (80 - r.s) % 9 for r in rows)


def test_ply_bins(spark):
    rows = spark.createDataFrame([(p,) for p in (0, 40, 41, 80, 81, 120, 121, 999)], "p int").select(scores.ply_bin(F.col("p")).alias("b")).collect()
    assert [r.b for r in rows] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_inf_in_any_case(spark):
    assert filters.parse_bands("1500:1.0,INF:0.1")[-1][0] == float("inf")
    t = filters.band_table(spark.createDataFrame([("1500:1.0,Inf:0.1",)], "spec string"))
    assert all(r.valid for r in t.collect())
