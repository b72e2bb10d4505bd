"""Queries over full boards: decoding, pieces, text positions (section 2.2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boards, dims
from ..session import scratch_path
from . import adapters as ad
from .registry import query

_SLOT = "CASE ptype " + " ".join(f"WHEN {t} THEN {i}" for i, t in enumerate(dims.HAND_TYPES)) + " END"
ad.add_view(
    "v_text",
    f"""SELECT b.pos_id, b.stm, k.bk, k.wk, t.board_text, h.hand_text
        FROM v_board b JOIN v_kings k USING (pos_id)
             JOIN (SELECT pos_id, string_agg(CAST(code AS VARCHAR), ' ' ORDER BY sq) AS board_text FROM v_square GROUP BY 1) t USING (pos_id)
             JOIN (SELECT p.pos_id, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ' ' ORDER BY slot) AS hand_text
                   FROM (SELECT pos_id, range AS slot FROM v_board, range(14)) p
                        LEFT JOIN (SELECT pos_id, owner * 7 + {_SLOT} AS slot, n FROM v_hand) c USING (pos_id, slot) GROUP BY 1) h USING (pos_id)""",
    ("v_board", "v_kings", "v_square", "v_hand"),
)


def as_text(df, *extra):
    """Board rows with the arrays as text, for comparison."""
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return df.select(
        "pos_id",
        F.col("stm").cast("int").alias("stm"),
        F.col("bk_sq").cast("int").alias("bk"),
        F.col("wk_sq").cast("int").alias("wk"),
        join("board").alias("board_text"),
        join(F.concat("black_hand", "white_hand")).alias("hand_text"),
        *extra,
    )


@query("decode_positions", "SELECT * FROM v_text", ("v_text",))
def decode_positions(spark, sf):
    packed = boards.encode_packed(ad.v_board(spark, sf)).select("pos_id", "sfen")
    return as_text(boards.decode_positions(packed))


# Every 50th record gets a flaw, so the quarantine has something of each kind to hold.
_FLAW = "(pos_id % 50 = 7)"
#: Positions with a lance on the board: the others cannot carry the flaw of the third kind.
_LANCE = "lance AS (SELECT DISTINCT pos_id FROM v_cell WHERE code = 4)"
_ABS = "CASE WHEN result = 0 THEN 0 WHEN (result = 1) = (stm = 0) THEN 1 ELSE 2 END"


def _huffman(spark, sf):
    kind = F.expr("CASE WHEN pos_id % 50 = 7 THEN (pos_id div 50) % 4 END")
    # a lance turned into a knight, whose code is as long, leaves too few of one and too many of the other
    swapped = F.expr("transform(board, (c, i) -> CAST(CASE WHEN i = array_position(board, 4Y) - 1 THEN 6 ELSE c END AS TINYINT))")
    rows = ad.v_board(spark, sf)
    b = boards.encode_huffman(rows.withColumn("board", F.when(kind == 2, swapped).otherwise(F.col("board"))))
    # a repeated king square, an unknown result, and all ones behind the kings, which run past the record's end
    pos = (
        F.when(kind == 0, F.expr("unhex(concat('0000', substring(hex(pos), 5)))"))
        .when(kind == 3, F.expr("unhex(concat(substring(hex(pos), 1, 8), repeat('F', 56)))"))
        .otherwise(F.col("pos"))
    )
    absolute = F.when(kind == 1, 7).otherwise(F.expr(_ABS))
    return b.select("pos_id", pos.alias("pos"), absolute.cast("int").alias("result"))


@query(
    "decode_hcpe_quarantine",
    f"{_LANCE} SELECT t.*, b.result FROM v_text t JOIN v_board b USING (pos_id) WHERE NOT ({_FLAW} AND ((pos_id // 50) % 4 <> 2 OR pos_id IN (SELECT pos_id FROM lance)))",
    ("v_text", "v_board", "v_cell"),
)
def decode_hcpe_quarantine(spark, sf):
    """Sound rows of a corpus with damaged records."""
    sound, _ = boards.quarantine(boards.decode_huffman(_huffman(spark, sf)))
    return as_text(sound, "result")


@query(
    "hcpe_quarantine_report",
    f"""{_LANCE} SELECT CASE (pos_id // 50) % 4 WHEN 0 THEN 'king squares' WHEN 1 THEN 'game result' WHEN 2 THEN 'piece inventory' ELSE '256-bit boundary' END AS error,
               count(*) AS n
        FROM v_board WHERE {_FLAW} AND ((pos_id // 50) % 4 <> 2 OR pos_id IN (SELECT pos_id FROM lance)) GROUP BY 1""",
    ("v_board", "v_cell"),
)
def hcpe_quarantine_report(spark, sf):
    """All rejected rows by reason."""
    _, rejected = boards.quarantine(boards.decode_huffman(_huffman(spark, sf)))
    return rejected.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hcpe_quarantine_counters",
    f"""{_LANCE}, k AS (SELECT CASE WHEN NOT ({_FLAW} AND ((pos_id // 50) % 4 <> 2 OR pos_id IN (SELECT pos_id FROM lance))) THEN 'sound'
                                WHEN (pos_id // 50) % 4 = 0 THEN 'king squares' WHEN (pos_id // 50) % 4 = 1 THEN 'game result' WHEN (pos_id // 50) % 4 = 2 THEN 'piece inventory'
                                ELSE '256-bit boundary' END AS reason FROM v_board)
        SELECT reason, count(*) AS n_counted, count(*) AS n_stored FROM k GROUP BY 1""",
    ("v_board", "v_cell"),
)
def hcpe_quarantine_counters(spark, sf):
    """Sound and rejected records written in one decode: what its counters saw, and what the two tables hold."""
    decoded = boards.decode_huffman(_huffman(spark, sf))
    sound, rejected, counters = boards.write_quarantine(decoded, scratch_path(spark, "quarantine"))
    stored = rejected.select(F.col("error").alias("reason")).union(sound.select(F.lit("sound"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n_stored"))
    counted = F.coalesce(*[F.when(F.col("reason") == k, F.lit(n)) for k, n in counters.items()])
    return stored.select("reason", counted.cast("bigint").alias("n_counted"), "n_stored")


@query(
    "sfen_to_positions",
    "SELECT * FROM v_text",
    ("v_text",),
)
def sfen_to_positions(spark, sf):
    text = boards.to_sfen(ad.v_board(spark, sf)).select("pos_id", "sfen_text")
    return as_text(boards.sfen_to_positions(text))


#: How texts of each kind are spoilt (``pos_id mod 19``; the last kind is sound) and what is wrong with them.
_EMPTY = "9/9/9/9/9/9/9/9/9"
_SPOILT = [
    ("concat(sfen_text, ' moves 7g7z')", "move text: 7g7z"),
    ("concat(b, '/9 ', s, ' ', h, ' 1')", "ranks"),
    ("concat('++P', sfen_text)", "promotion twice"),
    ("concat('+1', sfen_text)", "promotion of nothing"),
    ("concat(replace(b, '/', '+/'), ' ', s, ' ', h, ' 1')", "promotion at end"),
    ("concat('x', sfen_text)", "piece letter"),
    ("concat('1', sfen_text)", "long rank"),
    ("concat(regexp_replace(b, '^[^/]*', '8'), ' ', s, ' ', h, ' 1')", "short rank"),
    ("'moves 7g7f'", "no board"),
    ("concat('sfen ', b)", "no side"),
    ("concat('position sfen ', b, ' ', s)", "no hand"),
    ("concat(b, ' ', s, ' ', h)", "no ply"),
    ("concat(b, ' x ', h, ' 1')", "side letter"),
    ("concat(b, ' ', s, ' ', h, ' 65536')", "ply number"),
    ("concat(b, ' ', s, ' 2Q 1')", "hand letters"),
    ("concat(b, ' ', s, ' - 1 moves P*5e')", "nothing to drop: P*5e"),
    (f"concat('{_EMPTY} ', s, ' ', h, ' 1 moves 5e5d')", "nothing to move: 5e5d"),
    ("CAST(NULL AS STRING)", "no board"),
    ("sfen_text", None),
]
_REASONS = " ".join(f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(_SPOILT) if e)


@query(
    "sfen_rejects",
    f"SELECT pos_id, CASE pos_id % {len(_SPOILT)} {_REASONS} END AS error FROM v_board",
    ("v_board",),
)
def sfen_rejects(spark, sf):
    """Every position's text, most of them spoilt in one of the ways a text is rejected for, and the reason."""
    text = boards.to_sfen(ad.v_board(spark, sf)).select("pos_id", "sfen_text", *[F.split_part("sfen_text", F.lit(" "), F.lit(i + 1)).alias(c) for i, c in enumerate("bsh")])
    kinds = " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(_SPOILT))
    return boards.sfen_to_positions(text.select("pos_id", F.expr(f"CASE pos_id % {len(_SPOILT)} {kinds} END").alias("sfen_text"))).select("pos_id", "error")


_SQ_TEXT = "chr(CAST(49 + {s} // 9 AS INTEGER)) || chr(CAST(97 + {s} % 9 AS INTEGER))"


@query(
    "sfen_move_lists",
    """e AS (SELECT b.pos_id, b.stm, k.bk, k.wk, b.ply,
                    max(CASE WHEN (b.a * s + b.b) % 81 = 40 THEN s END) AS free, max(CASE WHEN (b.a * s + b.b) % 81 = 0 THEN s END) AS target
             FROM v_board b JOIN v_kings k USING (pos_id), range(81) AS r(s) GROUP BY 1, 2, 3, 4, 5)
       SELECT e.pos_id, e.stm, CAST(CASE WHEN e.stm = 0 THEN free ELSE target END AS INTEGER) AS bk, CAST(CASE WHEN e.stm = 0 THEN target ELSE free END AS INTEGER) AS wk,
              e.ply + 2 AS ply,
              CAST((SELECT coalesce(sum(n), 0) FROM v_hand h WHERE h.pos_id = e.pos_id) + CASE WHEN q.code > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_hand,
              CAST(NULL AS VARCHAR) AS error
       FROM e JOIN v_square q ON q.pos_id = e.pos_id AND q.sq = e.target""",
    ("v_board", "v_kings", "v_hand", "v_square"),
)
def sfen_move_lists(spark, sf):
    """Each position plus two king moves: one to an empty square, one taking a pawn if it is there."""
    b = boards.to_sfen(ad.v_board(spark, sf, parts=True))
    sq = lambda s: F.concat(F.char(F.lit(49) + F.floor(s / F.lit(9))), F.char(F.lit(97) + s % F.lit(9)))
    at = lambda item: F.expr(f"array_position(transform(sequence(0, 80), s -> (a * s + b) % 81), {item}) - 1")
    rows = b.withColumns({"free": at(40), "target": at(0)})
    mine = F.when(F.col("stm") == 0, F.col("bk_sq")).otherwise(F.col("wk_sq")).cast("int")
    other = F.when(F.col("stm") == 0, F.col("wk_sq")).otherwise(F.col("bk_sq")).cast("int")
    moves = F.concat(F.lit(" moves "), sq(mine), sq(F.col("free")), F.lit(" "), sq(other), sq(F.col("target")))
    text = rows.select("pos_id", F.concat(F.lit("position sfen "), F.col("sfen_text"), moves).alias("sfen_text"))
    out = boards.sfen_to_positions(text)
    held = F.aggregate(F.concat("black_hand", "white_hand"), F.lit(0), lambda a, x: a + x.cast("int"))
    return out.select(
        "pos_id",
        F.col("stm").cast("int").alias("stm"),
        F.col("bk_sq").cast("int").alias("bk"),
        F.col("wk_sq").cast("int").alias("wk"),
        "ply",
        held.cast("bigint").alias("n_hand"),
        "error",
    )


@query(
    "explode_pieces",
    """SELECT pos_id, CAST(row_number() OVER (PARTITION BY pos_id ORDER BY ptype, color, sq) - 1 AS INTEGER) AS slot, CAST(ptype AS INTEGER) AS ptype, CAST(color AS INTEGER) AS color, sq
       FROM v_cell WHERE ptype <> 8""",
    ("v_cell",),
)
def explode_pieces(spark, sf):
    """Pieces numbered in (type, color, square) order within their position."""
    pieces = boards.explode_pieces(ad.v_board(spark, sf), ["pos_id"])
    order = Window.partitionBy("pos_id").orderBy("ptype", "color", "sq")
    return pieces.select("pos_id", (F.row_number().over(order) - 1).alias("slot"), "ptype", "color", "sq")
