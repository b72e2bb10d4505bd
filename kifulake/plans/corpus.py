"""Queries over scored positions: scans, filters, games and splits (sections 2.1, 2.3, 2.4)."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, squares
from ..operators import checks, filters, games, ordering
from ..sources import versions
from . import adapters as ad
from .oracle_text import draws, games as games_sql, r
from .registry import query

BANDS_TEXT = "1500:1.0,3000:0.3,inf:0.1"
BANDS = filters.parse_bands(BANDS_TEXT)
SEED, EPOCH, BETA = 42, 3, 0.5
DROP, CLAMP = 32000, 3000

_P03, _P01 = repr(filters.float32(0.3)), repr(filters.float32(0.1))
_D03, _D01 = math.ceil(filters.float32(0.3) * (1 << 24)), math.ceil(filters.float32(0.1) * (1 << 24))
KEEP_SQL = f"(CASE WHEN abs(score) >= 32000 THEN {_P01} WHEN abs(score) <= 1500 THEN 1.0 WHEN abs(score) <= 3000 THEN {_P03} ELSE {_P01} END)::DOUBLE"
LIMIT_SQL = f"(CASE WHEN abs(score) >= 32000 THEN {_D01} WHEN abs(score) <= 1500 THEN 16777216 WHEN abs(score) <= 3000 THEN {_D03} ELSE {_D01} END)"
WDL_SQL = "(CASE WHEN result > 0 THEN 1.0 WHEN result = 0 THEN 0.5 ELSE 0.0 END)::DOUBLE"

# ------------------------------------------------------------------------------ scans


@query(
    "strided_sample_scan",
    """SELECT file_id, rec_idx, score FROM (
         SELECT *, row_number() OVER (ORDER BY file_id, rec_idx) AS rn FROM v_pos WHERE rec_idx >= 5 AND (rec_idx - 5) % 7 = 0)
       WHERE rn <= 1000""",
    ("v_pos",),
)
def strided_sample_scan(spark, sf):
    return checks.strided_sample(ad.v_pos(spark, sf), offset=5, stride=7, samples=1000).select("file_id", "rec_idx", "score")


_FILES_SQL = """
  f AS (SELECT file_id, rec_idx, ply, row_number() OVER (PARTITION BY file_id ORDER BY rec_idx) - 1 AS local_idx FROM v_pos),
  m AS (SELECT file_id, n, coalesce(sum(n) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT file_id, count(*) AS n FROM v_pos GROUP BY 1))"""


@query(
    "multi_file_union",
    f"{games_sql('g', 'v_pos')} SELECT file_id, rec_idx, game_seq FROM g",
    ("v_pos",),
)
def multi_file_union(spark, sf):
    """The corpus's files in order: game state restarts per file, numbering continues. One scan tags them all."""
    files = [f"file-{i}" for i in range(8)]
    named = ad.v_pos(spark, sf).select(F.concat(F.lit("file-"), "file_id").alias("path"), "rec_idx", "ply")
    return games.segment_games(checks.tag_files(named, "path", files)).select("file_id", "rec_idx", "game_seq")


@query(
    "global_record_index",
    f"{_FILES_SQL} SELECT file_id, rec_idx, local_idx, CAST(before + local_idx AS BIGINT) AS global_idx FROM f JOIN m USING (file_id)",
    ("v_pos",),
)
def global_record_index(spark, sf):
    rows = ordering.with_ordinal(ad.v_pos(spark, sf).select("file_id", "rec_idx"), out="global_idx", within_file="local_idx")
    return rows.select("file_id", "rec_idx", "local_idx", "global_idx")


@query(
    "keep_latest_k",
    """SELECT user_id, event_id FROM (
         SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
       WHERE rn <= 3""",
)
def keep_latest_k(spark, sf):
    """The three newest snapshots per user, from names as a checkpoint folder would list them."""
    names = ad.table(spark, sf, "events").select(
        F.format_string("u%d-%d.bin", F.col("user_id"), F.col("event_id")).alias("file_name")
    )
    kept = versions.keep_latest_k(names, "file_name", r"^u(\d+)-(\d+)\.bin$", 3)
    return kept.select(F.col("series").cast("bigint").alias("user_id"), F.col("version").alias("event_id"))


# ------------------------------------------------------------------------------ checks


@query(
    "position_crosscheck",
    """SELECT CAST(count(*) AS BIGINT) AS n_left, CAST(count(*) FILTER (WHERE rec_idx % 97 <> 5) AS BIGINT) AS n_right,
              CAST(count(*) FILTER (WHERE rec_idx % 97 = 5) AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right,
              CAST(count(*) FILTER (WHERE rec_idx % 97 <> 5 AND rec_idx % 13 = 0) AS BIGINT) AS diff_score,
              CAST(count(*) FILTER (WHERE rec_idx % 97 <> 5 AND rec_idx % 11 = 0) AS BIGINT) AS diff_result,
              CAST(0 AS BIGINT) AS diff_ply
       FROM v_pos""",
    ("v_pos",),
)
def position_crosscheck(spark, sf):
    """Positions against a perturbed decode of themselves, field by field."""
    left = ad.v_pos(spark, sf).select("rec_idx", "score", "result", "ply")
    i = F.col("rec_idx")
    right = left.where(i % 97 != 5).select(
        "rec_idx",
        F.when(i % 13 == 0, F.col("score") + 1).otherwise(F.col("score")).alias("score"),
        F.when(i % 11 == 0, F.lit(None)).otherwise(F.col("result")).alias("result"),
        "ply",
    )
    return checks.crosscheck(left, right, "rec_idx", ["score", "result", "ply"])


@query(
    "block_crosscheck",
    """r AS (SELECT *, rec_idx // 1024 AS block FROM v_pos),
       s AS (SELECT *, block % 5 = 2 AND rec_idx % 97 = 5 AS gone, CASE WHEN block % 5 = 3 AND rec_idx % 13 = 0 THEN NULL ELSE result END AS other FROM r)
       SELECT block, count(*) AS n_left, count(*) FILTER (WHERE NOT gone) AS n_right,
              count(*) FILTER (WHERE gone OR other IS DISTINCT FROM result) = 0 AS same FROM s GROUP BY 1""",
    ("v_pos",),
)
def block_crosscheck(spark, sf):
    """Which blocks of 1,024 records differ between positions and a copy that lost or changed some."""
    left = ad.v_pos(spark, sf).select("rec_idx", "score", "result", "ply")
    i, block = F.col("rec_idx"), F.floor(F.col("rec_idx") / 1024)
    right = left.where(~((block % 5 == 2) & (i % 97 == 5)))
    right = right.withColumn("result", F.when((block % 5 == 3) & (i % 13 == 0), F.lit(None)).otherwise(F.col("result")))
    return checks.block_differences(left, right, "rec_idx", ["score", "result", "ply"], 1024)


@query(
    "corpus_quality_check",
    """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE ply > 1024) AS BIGINT) AS bad_ply,
              CAST(count(*) FILTER (WHERE abs(score) > 32600) AS BIGINT) AS bad_score,
              CAST(count(*) FILTER (WHERE result NOT BETWEEN -1 AND 1) AS BIGINT) AS bad_result,
              CAST(count(*) FILTER (WHERE bk IS NULL OR wk IS NULL) AS BIGINT) AS bad_kings
       FROM v_board LEFT JOIN v_kings USING (pos_id)""",
    ("v_board", "v_cell", "v_kings"),
)
def corpus_quality_check(spark, sf):
    return checks.quality_report(ad.v_board(spark, sf))


# ------------------------------------------------------------------------------ filters


@query("score_drop", f"SELECT rec_idx, score FROM v_pos WHERE abs(score) < {DROP}", ("v_pos",))
def score_drop(spark, sf):
    return filters.score_drop(ad.v_pos(spark, sf), DROP).select("rec_idx", "score")


@query(
    "score_clamp",
    f"SELECT rec_idx, greatest(least(score, {CLAMP}), -{CLAMP}) AS score FROM v_pos WHERE abs(score) < {DROP}",
    ("v_pos",),
)
def score_clamp(spark, sf):
    return filters.score_clamp(filters.score_drop(ad.v_pos(spark, sf), DROP), CLAMP).select("rec_idx", "score")


@query("band_keep_probability", f"SELECT rec_idx, {r(KEEP_SQL)} AS p FROM v_pos", ("v_pos",))
def band_keep_probability(spark, sf):
    return ad.v_pos(spark, sf).select("rec_idx", scores.r(filters.keep_probability(F.col("score"), BANDS)).alias("p"))


@query(
    "band_sample",
    f"{draws('d', 'v_pos', SEED, str(EPOCH))} SELECT rec_idx, score, u24 FROM d WHERE u24 < {LIMIT_SQL}",
    ("v_pos",),
)
def band_sample(spark, sf):
    return filters.band_sample(ad.v_pos(spark, sf), BANDS, SEED, EPOCH, keep_draw=True).select("rec_idx", "score", "u24")


@query("importance_weight", f"SELECT rec_idx, {r(f'pow({KEEP_SQL}, -{BETA})')} AS weight FROM v_pos", ("v_pos",))
def importance_weight(spark, sf):
    return ad.v_pos(spark, sf).select(
        "rec_idx", scores.r(filters.importance_weight(F.col("score"), BANDS, BETA)).alias("weight")
    )


_SPEC = "concat(cast(500 + user_id as {s}), ':1.0,', cast(1500 + user_id % 7 * 300 as {s}), ':0.', cast(1 + user_id % 9 as {s}), ',inf:0.1')"


@query(
    "band_table",
    """s AS (SELECT DISTINCT user_id FROM events),
       b AS (SELECT user_id, unnest([0, 1, 2]) AS band, 500 + user_id AS u0, 1500 + user_id % 7 * 300 AS u1, 1 + user_id % 9 AS p1 FROM s)
       SELECT user_id, band, CAST(CASE band WHEN 1 THEN u0 WHEN 2 THEN u1 END AS INTEGER) AS lower_excl,
              CAST(CASE band WHEN 0 THEN u0 WHEN 1 THEN u1 END AS INTEGER) AS upper_incl,
              round(CASE band WHEN 0 THEN 1.0 WHEN 1 THEN p1 / 10.0 ELSE 0.1 END::DOUBLE, 6) + 0.0 AS p, u1 > u0 AS valid FROM b""",
)
def band_table(spark, sf):
    """One band configuration per user, parsed and checked as a table."""
    users = ad.table(spark, sf, "events").select("user_id").distinct()
    bands = filters.band_table(users.withColumn("spec", F.expr(_SPEC.format(s="string"))))
    return bands.select("user_id", "band", "lower_excl", "upper_incl", scores.r(F.col("p").cast("double")).alias("p"), "valid")


@query(
    "result_to_wdl",
    f"""SELECT rec_idx, {WDL_SQL} AS wdl, CASE WHEN result > 0 THEN 'Win' WHEN result < 0 THEN 'Loss' ELSE 'Draw' END AS outcome,
               CAST(CASE WHEN rec_idx % 3 = 0 THEN 0 WHEN (rec_idx % 3) - 1 = ply % 2 THEN 1 ELSE -1 END AS INTEGER) AS relative
        FROM v_pos""",
    ("v_pos",),
)
def result_to_wdl(spark, sf):
    absolute, stm = F.col("rec_idx") % 3, F.col("ply") % 2
    return ad.v_pos(spark, sf).select(
        "rec_idx",
        scores.result_to_wdl(F.col("result")).alias("wdl"),
        scores.result_name(F.col("result")).alias("outcome"),
        scores.absolute_to_relative(absolute, stm).alias("relative"),
    )


@query(
    "ply_bin",
    """x AS (SELECT rec_idx, rec_idx % 160 AS p FROM v_pos)
       SELECT rec_idx, CASE WHEN p <= 40 THEN 0 WHEN p <= 80 THEN 1 WHEN p <= 120 THEN 2 ELSE 3 END AS bin,
              CASE WHEN p <= 40 THEN '1-40' WHEN p <= 80 THEN '41-80' WHEN p <= 120 THEN '81-120' ELSE '121+' END AS label FROM x""",
    ("v_pos",),
)
def ply_bin(spark, sf):
    rows = ad.v_pos(spark, sf).select("rec_idx", scores.ply_bin(F.col("rec_idx") % 160).alias("bin"))
    return rows.withColumn("label", scores.ply_bin_label(F.col("bin")))


@query(
    "square_transform",
    """SELECT pos_id, bk, 80 - wk AS wk_inverse, (8 - bk // 9) * 9 + bk % 9 AS bk_mirror,
              CASE WHEN stm = 0 THEN bk ELSE 80 - bk END AS bk_seen,
              CASE WHEN (80 - wk) // 9 >= 5 THEN (8 - (80 - wk) // 9) * 9 + (80 - wk) % 9 ELSE 80 - wk END AS wk_own
       FROM v_board JOIN v_kings USING (pos_id)""",
    ("v_board", "v_cell", "v_kings"),
)
def square_transform(spark, sf):
    b = ad.v_board(spark, sf)
    bk, wk = F.col("bk_sq").cast("int"), F.col("wk_sq").cast("int")
    own = squares.viewed_by(wk, F.lit(1))
    return b.select(
        "pos_id",
        bk.alias("bk"),
        squares.inverse(wk).alias("wk_inverse"),
        squares.mirror_file(bk).alias("bk_mirror"),
        squares.viewed_by(bk, F.col("stm")).alias("bk_seen"),
        squares.viewed_by(wk, F.lit(1), squares.file_of(own) >= 5).alias("wk_own"),
    )


@query("nonempty_guard", f"SELECT count(*) AS n FROM v_pos WHERE abs(score) < {DROP}", ("v_pos",))
def nonempty_guard(spark, sf):
    return filters.guarded_count(filters.score_drop(ad.v_pos(spark, sf), DROP), "events")


# ------------------------------------------------------------------------------ games


@query("segment_games", f"{games_sql('g', 'v_pos')} SELECT file_id, game_seq, count(*) AS n, min(rec_idx) AS first_idx FROM g GROUP BY 1, 2", ("v_pos",))
def segment_games(spark, sf):
    g = games.segment_games(ad.v_pos(spark, sf))
    return g.groupBy("file_id", "game_seq").agg(F.count(F.lit(1)).alias("n"), F.min("rec_idx").alias("first_idx"))


@query("segment_games_seq", f"{games_sql('g', 'v_seq')} SELECT rec_idx, game_seq FROM g", ("v_seq",))
def segment_games_seq(spark, sf):
    """One file of many games: the stream is cut in blocks smaller than the file."""
    return games.segment_games(ad.v_seq(spark, sf), block_rows=4096).select("rec_idx", "game_seq")


_TARGETS = f"""{games_sql('g', 'v_seq')},
  t AS (SELECT rec_idx, game_seq, count(*) OVER (PARTITION BY game_seq) AS game_len,
               row_number() OVER (PARTITION BY game_seq ORDER BY rec_idx) - 1 AS i FROM g)"""


@query(
    "game_relative_target",
    f"{_TARGETS} SELECT rec_idx, game_len, i, {r('CASE WHEN game_len > 1 THEN i / (game_len - 1)::DOUBLE ELSE 0.0 END')} AS target FROM t",
    ("v_seq",),
)
def game_relative_target(spark, sf):
    t = games.with_game_targets(games.segment_games(ad.v_seq(spark, sf)))
    return t.select("rec_idx", "game_len", "i", scores.r(F.col("target")).alias("target"))


def _routed(spark, sf, fraction, per_step, with_norm=True):
    t = games.with_game_targets(games.segment_games(ad.v_seq(spark, sf)))
    t = games.route_games(t, fraction, per_step)
    return games.with_position_norm(t, per_step) if with_norm else t


@query(
    "per_position_norm",
    f"""{_TARGETS},
      s AS (SELECT *, game_seq // 16 AS step_id FROM t),
      k AS (SELECT step_id, count(DISTINCT game_seq) AS n_games FROM s GROUP BY 1)
      SELECT rec_idx, step_id, {r('1.0 / (game_len * n_games)', 9)} AS norm FROM s JOIN k USING (step_id)""",
    ("v_seq",),
)
def per_position_norm(spark, sf):
    return _routed(spark, sf, 0.0, 16).select("rec_idx", "step_id", scores.r(F.col("norm"), 9).alias("norm"))


@query(
    "game_sequence_number",
    f"{games_sql('g', 'v_pos')} SELECT file_id, rec_idx, game_seq FROM g",
    ("v_pos",),
)
def game_sequence_number(spark, sf):
    """Every record with the number of its game over all files in order."""
    return games.segment_games(ad.v_pos(spark, sf)).select("file_id", "rec_idx", "game_seq")


@query(
    "training_games_cap",
    f"{games_sql('g', 'v_pos')} SELECT file_id, rec_idx, game_seq FROM g WHERE game_seq < 200",
    ("v_pos",),
)
def training_games_cap(spark, sf):
    """The games cap of a training pass: the first 200 games over all files in order."""
    return games.route_games(games.segment_games(ad.v_pos(spark, sf)), 0.0, 16, max_games=200).select(
        "file_id", "rec_idx", "game_seq"
    )


@query(
    "holdout_every_nth_game",
    f"{games_sql('g', 'v_seq')} SELECT rec_idx, game_seq, game_seq % 20 = 0 AS is_val FROM g",
    ("v_seq",),
)
def holdout_every_nth_game(spark, sf):
    return _routed(spark, sf, 0.05, 16, False).select("rec_idx", "game_seq", "is_val")


@query(
    "step_batches",
    f"""{games_sql('g', 'v_seq')},
      k AS (SELECT game_seq, game_seq % 20 = 0 AS is_val, count(*) AS n FROM g GROUP BY 1, 2),
      s AS (SELECT *, (row_number() OVER (PARTITION BY is_val ORDER BY game_seq) - 1) // 16 AS step_id FROM k)
      SELECT is_val, step_id, count(*) AS n_games, CAST(sum(n) AS BIGINT) AS n_positions FROM s GROUP BY 1, 2""",
    ("v_seq",),
)
def step_batches(spark, sf):
    t = _routed(spark, sf, 0.05, 16, False)
    per_game = t.groupBy("is_val", "step_id", "game_seq").agg(F.count(F.lit(1)).alias("n"))
    return per_game.groupBy("is_val", "step_id").agg(F.count(F.lit(1)).alias("n_games"), F.sum("n").alias("n_positions"))


# ------------------------------------------------------------------------------ splits


@query(
    "tail_holdout_split",
    """x AS (SELECT rec_idx, row_number() OVER (ORDER BY rec_idx) AS rn, count(*) OVER () AS n FROM v_pos)
       SELECT rec_idx, CASE WHEN rn > n - 500 THEN 'holdout' ELSE 'train' END AS split FROM x""",
    ("v_pos",),
)
def tail_holdout_split(spark, sf):
    one_file = ad.v_pos(spark, sf).select(F.lit(0).alias("file_id"), "rec_idx")
    return games.tail_split(one_file, 500).select("rec_idx", "split")


@query(
    "fixed_holdout_set",
    f"""x AS (SELECT file_id, rec_idx, greatest(least(score, {CLAMP}), -{CLAMP}) AS score,
                    row_number() OVER (ORDER BY file_id, rec_idx) - 1 AS rn, count(*) OVER () AS n
             FROM v_pos WHERE abs(score) < {DROP})
        SELECT file_id, rec_idx, score, rn // 64 AS batch_id FROM x WHERE rn < (least(n, 512) // 64) * 64""",
    ("v_pos",),
)
def fixed_holdout_set(spark, sf):
    """500 requested positions in batches of 64: eight full batches."""
    usable = filters.score_clamp(filters.score_drop(ad.v_pos(spark, sf), DROP), CLAMP)
    return games.fixed_holdout(usable, 500, 64).select("file_id", "rec_idx", "score", "batch_id")


@query(
    "epoch_expand",
    f"""e AS (SELECT rec_idx, score, epoch FROM v_pos, (SELECT unnest([0, 1, 2]) AS epoch)),
        {draws('d', 'e', SEED, 'epoch')}
        SELECT epoch, rec_idx, score FROM d WHERE u24 < {LIMIT_SQL}""",
    ("v_pos",),
)
def epoch_expand(spark, sf):
    passes = games.epoch_expand(ad.v_pos(spark, sf).select("rec_idx", "score"), 3)
    return filters.band_sample(passes, BANDS, SEED, F.col("epoch_term")).select("epoch", "rec_idx", "score")


@query(
    "superbatch_assign",
    """x AS (SELECT file_id, rec_idx, row_number() OVER (ORDER BY file_id, rec_idx) - 1 AS rn FROM v_pos)
       SELECT file_id, rec_idx, rn // 64 AS batch_id, rn // 640 AS superbatch_id FROM x""",
    ("v_pos",),
)
def superbatch_assign(spark, sf):
    return games.superbatch_assign(ad.v_pos(spark, sf).select("file_id", "rec_idx"), 64, 10)
