import pytest
from pyspark.sql import functions as F

from kifulake.operators import boards, dims, edges, features, progress
from kifulake.operators.features import FEATURE_SETS

START = boards.START_POSITION


def from_text(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos_id bigint, sfen_text string")
    return boards.sfen_to_positions(df)


def board_of(spark, kings, pieces=(), stm=0):
    """A position from (file, rank) squares: kings, then (color, type, file, rank)."""
    cells = [0] * 81
    sq = lambda f, r: f * 9 + r
    cells[sq(*kings[0])], cells[sq(*kings[1])] = 16, 17
    for color, t, f, r in pieces:
        cells[sq(f, r)] = t * 2 + color
    row = (0, cells, [0] * 7, [0] * 7, stm, sq(*kings[0]), sq(*kings[1]))
    return spark.createDataFrame(
        [row], "pos_id bigint, board array<tinyint>, black_hand array<tinyint>, white_hand array<tinyint>, stm tinyint, bk_sq tinyint, wk_sq tinyint"
    )


def pairs(df):
    return [(r.stm_idx, r.nstm_idx) for r in df.collect()]


def test_start_position_edges(spark):
    e = edges.attack_edges(from_text(spark, "startpos"), ["pos_id", "stm", "bk_sq", "wk_sq"])
    full = pairs(edges.edge_feature_index(e, "full"))
    want = [
        1330, 1618, 7147, 7148, 7231, 7232, 11047, 11213, 16475, 16578, 23268, 23270, 24087, 25717, 37487, 40080, 43974,
        112573, 112861, 116503, 116504, 116587, 116588, 122160, 122650, 128533, 128636, 138321, 138323, 139136, 140770,
        158280, 160871, 164753,
    ]
    assert sorted(s for s, _ in full) == want and sorted(n for _, n in full) == want
    dead = edges.canonical_dead_edge(edges.mutual_edge_flag(e))
    kept = pairs(edges.edge_feature_index(dead, "full-symdedup"))
    assert sorted(s for s, _ in kept) == [i for i in want if i not in (11047, 122160)]


def test_edge_dimensions(spark):
    sizes = [216720, 192640, 173568, 33408, 216720, 96320]
    for profile, size in zip(dims.PROFILES, sizes):
        p = dims.pair_ranges(spark, profile).agg(F.max(F.col("base") + F.col("width")).alias("d"), F.count("*").alias("n")).first()
        assert p.d == size
        ranges = dims.pair_ranges(spark, profile)
        got = dims.with_pair(spark.range(size).withColumnRenamed("id", "row"), profile).groupBy(*dims.PAIR_KEY)
        got = got.agg(F.min("row").alias("base"), F.count("*").alias("width")).select(*ranges.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ranges.collect()))


def test_pair_lookup_needs_no_join(spark):
    found = dims.with_pair(spark.range(9).withColumnRenamed("id", "row"), "full")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert dims.with_pair(spark.createDataFrame([], "row long"), "full").count() == 0
    for row in ("-1", "216720", "null"):
        with pytest.raises(Exception, match="outside profile"):
            dims.with_pair(spark.sql(f"select cast({row} as bigint) as row"), "full").collect()


@pytest.mark.parametrize(
    "name,kings,want",
    [
        ("halfka-hm-merged", ((4, 8), (4, 0)), [(73268, 73268), (73260, 73260)]),
        ("halfka-merged", ((0, 0), (8, 8)), [(1548, 1548), (1628, 1628)]),
        ("halfka-hm-split", ((6, 2), (2, 6)), [(35768, 35768), (35889, 35889)]),
    ],
)
def test_kings_only_features(spark, name, kings, want):
    assert sorted(pairs(features.half_features(board_of(spark, kings), name, []))) == sorted(want)


def test_effect_bucket_golden(spark):
    p = dims
    pieces = [
        (0, p.GOLD, 3, 7), (0, p.SILVER, 4, 7), (0, p.HORSE, 6, 6), (0, p.PAWN, 2, 5), (0, p.PAWN, 4, 5),
        (1, p.GOLD, 4, 1), (1, p.SILVER, 5, 1), (1, p.DRAGON, 2, 2), (1, p.PAWN, 4, 3), (1, p.LANCE, 0, 4), (0, p.PAWN, 0, 6),
    ]
    got = pairs(features.effect_bucket_features(board_of(spark, ((4, 8), (4, 0)), pieces), 4, False, []))
    assert sorted(s for s, _ in got) == [
        287089, 287157, 287228, 287544, 288052, 289182, 289518, 289794, 290130, 291192, 292653, 293040, 293072,
    ]
    assert sorted(n for _, n in got) == [
        287228, 287544, 287617, 287685, 288016, 289146, 289482, 289830, 290166, 291356, 292489, 293040, 293072,
    ]


def test_king_rank_goldens(spark):
    texts = [
        START, "lnsg1gsnl/1r2k2b1/ppppppppp/9/9/9/PPPPPPPPP/1B2K2R1/LNSG1GSNL w - 1", "9/9/4K4/9/9/9/4k4/9/9 b - 1",
        "9/9/9/4K4/4k4/9/9/9/9 b - 1", START.replace(" b ", " w "),
    ]
    rows = progress.bucket_assign(from_text(spark, *texts), "kingrank9").orderBy("pos_id").collect()
    assert [r.bucket for r in rows] == [8, 8, 0, 4, 8]


def test_start_position_counts(spark):
    pos = from_text(spark, "startpos")
    assert features.kp_progress_features(pos, ["pos_id"]).count() == 76
    for name, fs in FEATURE_SETS.items():
        got = pairs(features.half_features(pos, name, []))
        assert len(got) == fs.max_active and all(0 <= s < fs.ft_in and 0 <= n < fs.ft_in for s, n in got)
        assert len({s for s, _ in got}) == len(got)
    row = features.material_balance(pos, []).first()
    assert row.stm_material == 0 and row.nstm_material == 0


def test_too_many_active_features_fail(spark):
    f = features.half_features(from_text(spark, "startpos"), "halfka-merged", ["pos_id"])
    assert features.active_feature_count(f, "pos_id", 40).first().nnz == 40
    with pytest.raises(Exception, match="active features"):
        features.active_feature_count(f, "pos_id", 39).collect()


HCPE_MID = bytes.fromhex("8db809150600008085f06e4afc622be14589e313fe5e61a2040300608c0f67bde9072b1a0200")
PSV_MID = bytes.fromhex("8db811190600008083f09e52fce14ce1458ae50b7e5f612405c3a31400c09d95e9072b1a01000100")
HCPE_EARLY = bytes.fromhex("8cae09150600008085f06e4abc6c258012c7a73f1cc244090600c0f970ce7aff86f8b82b0200")
PSV_EARLY = bytes.fromhex("8cae11190600008083f09e52bc9c298014cb975f2cc2480a86c701007cefac9586f8b8430100ff00")


@pytest.mark.parametrize("hcpe,psv", [(HCPE_MID, PSV_MID), (HCPE_EARLY, PSV_EARLY)])
def test_both_formats_decode_alike(spark, hcpe, psv):
    a = spark.createDataFrame([(0, bytearray(psv[:32]))], "pos_id bigint, sfen binary")
    b = spark.createDataFrame([(0, bytearray(hcpe[:32]), hcpe[36])], "pos_id bigint, pos binary, result int")
    x = boards.decode_positions(a).first()
    y = boards.decode_huffman(b).first()
    assert y.error is None and y.result == int.from_bytes(psv[38:39], "little", signed=True)
    for c in ("board", "black_hand", "white_hand", "stm", "bk_sq", "wk_sq"):
        assert x[c] == y[c], c
    # pieces in hand may be listed in any order, so compare what the new bytes say
    again = boards.decode_positions(boards.encode_packed(boards.decode_positions(a)).select("pos_id", "sfen")).first()
    other = boards.encode_huffman(boards.decode_huffman(b).drop("result", "raw", "error"))
    other = boards.decode_huffman(other.select("pos_id", "pos", F.lit(0).alias("result"))).first()
    for c in ("board", "black_hand", "white_hand", "stm", "bk_sq", "wk_sq"):
        assert again[c] == x[c] and other[c] == x[c], c
    assert other.error is None


def test_no_flipped_bit_yields_a_bad_inventory(spark):
    rows = []
    for k in range(256):
        raw = bytearray(HCPE_MID[:32])
        raw[k // 8] ^= 1 << (k % 8)
        rows.append((k, raw, 1))
    out = boards.decode_huffman(spark.createDataFrame(rows, "pos_id bigint, pos binary, result int")).collect()
    assert any(r.error == "piece inventory" for r in out)
    for r in out:
        assert (r.error is None) == (r.raw is None)
        if r.error is None:
            kinds = [dims.UNPROMOTED.get(c // 2, c // 2) for c in r.board]
            for slot, t in enumerate(dims.HAND_TYPES):
                assert kinds.count(t) + r.black_hand[slot] + r.white_hand[slot] == dims.INVENTORY[t]


@pytest.mark.parametrize(
    "text,reason",
    [
        ("9/9/9 b - 1", "ranks"),
        ("10/9/9/9/9/9/9/9/9 b - 1", "short rank"),
        ("9p/9/9/9/9/9/9/9/9 b - 1", "long rank"),
        ("8+/9/9/9/9/9/9/9/9 b - 1", "promotion at end"),
        ("+9/9/9/9/9/9/9/9/9 b - 1", "promotion of nothing"),
        ("++p8/9/9/9/9/9/9/9/9 b - 1", "promotion twice"),
        ("x8/9/9/9/9/9/9/9/9 b - 1", "piece letter"),
        ("9/9/9/9/9/9/9/9/9 x - 1", "side letter"),
        ("9/9/9/9/9/9/9/9/9 b K 1", "hand"),
        ("9/9/9/9/9/9/9/9/9 b P2 1", "hand"),
        ("9/9/9/9/9/9/9/9/9 b - x", "ply"),
        ("9/9/9/9/9/9/9/9/9 b -", "ply"),
        ("startpos moves 5e5d", "nothing to move"),
        ("startpos moves P*5e", "nothing to drop"),
        ("startpos moves zz", "move text"),
    ],
)
def test_text_errors(spark, text, reason):
    assert reason in from_text(spark, text).first().error


def test_moves(spark):
    text = "position startpos moves 7g7f 3c3d 8h2b+ 3a2b B*4e"
    r = from_text(spark, text).first()
    assert r.error is None and r.ply == 6 and r.stm == 1
    at = lambda f, rank: r.board[(f - 1) * 9 + rank - 1]
    assert at(2, 2) == dims.SILVER * 2 + 1 and at(4, 5) == dims.BISHOP * 2 and at(7, 6) == dims.PAWN * 2
    assert r.black_hand[5] == 0 and r.white_hand[5] == 1  # the promoted bishop went back plain
    back = boards.to_sfen(from_text(spark, text).drop("sfen_text", "error")).first().sfen_text
    assert back == "lnsgkg1nl/1r5s1/pppppp1pp/6p2/5B3/2P6/PP1PPPPPP/7R1/LNSGKGSNL w b 6"


@pytest.mark.parametrize("name", ["halfka-hm-merged", "halfka-split", "halfkp"])
def test_id_arrays_equal_feature_rows(spark, sf, name):
    """Row-local ids of every set are the ids that the row form has, views kept apart."""
    from kifulake.plans import adapters as ad

    board = ad.v_board(spark, sf)
    arrays = features.with_half_ids(board, name).select("pos_id", F.sort_array("stm_ids").alias("s"), F.sort_array("nstm_ids").alias("n"))
    rows = features.half_features(board, name, ["pos_id"]).groupBy("pos_id").agg(
        F.sort_array(F.collect_list("stm_idx")).alias("s"), F.sort_array(F.collect_list("nstm_idx")).alias("n")
    )
    assert arrays.exceptAll(rows).isEmpty() and rows.exceptAll(arrays).isEmpty()


@pytest.mark.parametrize("profile", ["full", "full-symdedup", "cross-side", "same-class-major-pawn"])
def test_edge_arrays_equal_edge_rows(spark, sf, profile):
    from kifulake.operators import edges
    from kifulake.plans import adapters as ad

    board = ad.v_board(spark, sf)
    arrays = edges.with_edge_ids(board, profile, 0, "s", "n").where(F.size("s") > 0).select("pos_id", F.sort_array("s").alias("s"), F.sort_array("n").alias("n"))
    e = edges.attack_edges(board, ["pos_id", "stm", "bk_sq", "wk_sq"])
    rows = edges.edge_feature_index(edges.canonical_dead_edge(edges.mutual_edge_flag(e)), profile).groupBy("pos_id").agg(
        F.sort_array(F.collect_list(F.col("stm_idx").cast("int"))).alias("s"), F.sort_array(F.collect_list(F.col("nstm_idx").cast("int"))).alias("n")
    )
    assert arrays.exceptAll(rows).isEmpty() and rows.exceptAll(arrays).isEmpty()


def test_encoders_keep_nulls_and_long_positions(spark):
    start = boards.sfen_to_positions(spark.createDataFrame([("startpos",)], "sfen_text string")).drop("sfen_text", "error", "ply")
    rows = start.union(start.withColumn("board", F.lit(None).cast("array<tinyint>"))).union(start.withColumn("bk_sq", F.lit(None).cast("tinyint")))
    # too many pieces for 256 bits: cut off, as the record is
    full = start.withColumn("black_hand", F.expr("transform(sequence(1, 7), x -> CAST(18 AS TINYINT))"))
    for encode, out in ((boards.encode_packed, "sfen"), (boards.encode_huffman, "pos")):
        got = [r[out] for r in encode(rows).collect()]
        assert len(got[0]) == 32 and got[1:] == [None, None]
        long = encode(full).first()[out]
        assert len(long) == 32 and long[:8] == got[0][:8]
        assert encode(rows.where("false")).count() == 0
    again = boards.decode_positions(boards.encode_packed(start).select(F.lit(1).alias("pos_id"), "sfen")).drop("pos_id")
    assert again.select(*start.columns).collect() == start.collect()
