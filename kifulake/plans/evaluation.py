"""Queries over predictions, histograms, tensors and run histories (sections 2.7, 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schedules as sch
from ..functions.scores import r as rnd, result_to_wdl, sigmoid, win_rate
from ..operators import checks, dims, filters, games, losses, metrics, runs, surveys, tensors
from . import adapters as ad
from .corpus import BANDS, BETA, CLAMP, DROP, EPOCH, KEEP_SQL, LIMIT_SQL, SEED, WDL_SQL
from .oracle_text import draws, r, sig, win_rate as wr_sql
from .registry import query

# ------------------------------------------------------------------------- predictions


def v_pred(spark, sf):
    """Usable positions with a model output derived from the score, and loss weights."""
    pos = filters.score_drop(ad.v_pos(spark, sf), DROP)
    out = (F.col("score") * 0.8 + ((F.col("rec_idx") * 7919) % 601 - 300)) / F.lit(600.0)
    return pos.select(
        "file_id", "rec_idx", "score", "result", "ply", "day",
        out.alias("out"),
        result_to_wdl(F.col("result")).alias("wdl"),
        F.lit(1.0 / 1024).alias("norm"),
        filters.importance_weight(F.col("score"), BANDS, BETA).alias("importance"),
    )


ad.add_view(
    "v_pred",
    f"""SELECT file_id, rec_idx, score, result, ply, day, (score * 0.8::DOUBLE + ((rec_idx * 7919) % 601 - 300)) / 600.0::DOUBLE AS out,
               {WDL_SQL} AS wdl, (1.0 / 1024)::DOUBLE AS norm, pow({KEEP_SQL}, -{BETA}) AS importance
        FROM v_pos WHERE abs(score) < {DROP}""",
    ("v_pos",),
)

_SCALE, _BLEND = 1.0 / 410.0, 0.25


@query(
    "sigmoid_mse_loss",
    f"""e AS (SELECT file_id, {sig(f'out * {_SCALE!r}')} AS p, {_BLEND} * wdl + {1 - _BLEND} * {sig(f'score * {_SCALE!r}')} AS y FROM v_pred)
        SELECT file_id, count(*) AS n, {r('sum((p - y) * (p - y))')} AS loss, {r('avg((p - y) * (p - y))', 9)} AS mean_loss,
               {r(f'sum(abs(2.0 * (p - y) * p * (1 - p) * {_SCALE!r} / 1024)) * 1e6')} AS grad_l1
        FROM e GROUP BY 1""",
    ("v_pred",),
)
def sigmoid_mse_loss(spark, sf):
    e = losses.sigmoid_mse(v_pred(spark, sf), _SCALE, _BLEND)
    return e.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.sum("sq_err")).alias("loss"),
        rnd(F.avg("sq_err"), 9).alias("mean_loss"),
        rnd(F.sum(F.abs("grad")) * 1e6).alias("grad_l1"),
    )


@query("win_rate_transform", f"SELECT rec_idx, {r(wr_sql('score', 270.0, 380.0), 9)} AS p FROM v_pos", ("v_pos",))
def win_rate_transform(spark, sf):
    return ad.v_pos(spark, sf).select("rec_idx", rnd(win_rate(F.col("score"), 270.0, 380.0), 9).alias("p"))


K = losses.WinRateLoss(blend=0.1)
KG = losses.WinRateLoss(blend=0.1, power=2.5, asymmetry=0.2, boost_w1=1.0, boost_w2=0.5)


def _wrm_cte(k: losses.WinRateLoss) -> str:
    net = f"out * {k.to_score}"
    return f"""
  e0 AS (SELECT *, {wr_sql('score', k.target_offset, k.target_scaling)} AS pf,
                {sig(f'({net} - {k.in_offset}) / {k.in_scaling}')} AS q, {sig(f'(-({net}) - {k.in_offset}) / {k.in_scaling}')} AS qm FROM v_pred),
  e1 AS (SELECT *, 0.5 * (1 + q - qm) AS qf, {k.blend} * wdl + {1 - k.blend} * pf AS tgt,
                {k.to_score / k.in_scaling!r} * (q * (1 - q) + qm * (1 - qm)) AS slope FROM e0),
  e AS (SELECT *, qf - tgt AS err FROM e1)"""


@query(
    "wrm_loss",
    f"""{_wrm_cte(K)} SELECT file_id, count(*) AS n, {r('sum(err * err)')} AS loss, {r('sum(err * slope * norm)')} AS grad_sum
        FROM e GROUP BY 1""",
    ("v_pred",),
)
def wrm_loss(spark, sf):
    e = losses.win_rate_loss(v_pred(spark, sf), K)
    return e.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("sq_err")).alias("loss"), rnd(F.sum("grad")).alias("grad_sum")
    )


def _general_sql(importance: str) -> str:
    return f"""{_wrm_cte(KG)},
  w AS (SELECT *, {importance} * (1 + (pow(2.0, {KG.boost_w1}) - 1) * pow((pf - 0.5) * (pf - 0.5) * pf * (1 - pf), {KG.boost_w2})) AS wt,
               CASE WHEN qf > tgt THEN {1 + KG.asymmetry} ELSE 1.0 END AS asym FROM e)
  SELECT file_id, count(*) AS n, {r('sum(wt)')} AS sum_weight,
         {r(f'sum(asym * pow(abs(err), {KG.power}) * wt) / sum(wt)', 9)} AS mean_loss,
         {r(f'sum(abs(wt * asym * {KG.power} * pow(abs(err), {KG.power - 1}) * 0.5 * slope)) / sum(wt)', 9)} AS grad_l1
  FROM w GROUP BY 1"""


def _general(df, importance):
    return losses.general_loss(df, KG, importance, by=["file_id"]).select(
        "file_id", "n", rnd(F.col("sum_weight")).alias("sum_weight"),
        rnd(F.col("mean_loss"), 9).alias("mean_loss"), rnd(F.col("grad_l1"), 9).alias("grad_l1"),
    )


@query("wrm_loss_general", _general_sql("1.0"), ("v_pred",))
def wrm_loss_general(spark, sf):
    return _general(v_pred(spark, sf), None)


@query("importance_weighted_loss", _general_sql("importance"), ("v_pred",))
def importance_weighted_loss(spark, sf):
    return _general(v_pred(spark, sf), "importance")


@query(
    "ablation_delta",
    f"""z AS (SELECT pos_id, sum(w) AS z0, sum(CASE WHEN length(token) <= 3 THEN 0 ELSE w END) AS z1,
                    sum(CASE WHEN length(token) >= 8 THEN 0 ELSE w END) AS z2,
                    sum(CASE WHEN token LIKE '%.' THEN 0 ELSE w END) AS z3 FROM v_feat GROUP BY 1),
        l AS (SELECT avg(pow({sig('z0')} - target, 2)) AS l0, avg(pow({sig('z1')} - target, 2)) AS l1,
                     avg(pow({sig('z2')} - target, 2)) AS l2, avg(pow({sig('z3')} - target, 2)) AS l3 FROM z JOIN v_target USING (pos_id)),
        s AS (SELECT 'short' AS spec, l1 AS loss, l1 - l0 AS delta FROM l UNION ALL SELECT 'long', l2, l2 - l0 FROM l
              UNION ALL SELECT 'sentence-end', l3, l3 - l0 FROM l)
        SELECT spec, {r('loss', 8)} AS loss, {r('delta', 8)} AS delta FROM s""",
    ("v_feat", "v_target"),
)
def ablation_delta(spark, sf):
    n = F.length("token")
    specs = {"short": n <= 3, "long": n >= 8, "sentence-end": F.col("token").endswith(".")}
    out = losses.ablation_delta(ad.v_feat(spark, sf), ad.v_target(spark, sf), specs)
    return out.select("spec", rnd(F.col("loss"), 8).alias("loss"), rnd(F.col("delta"), 8).alias("delta"))


_HIT = "CASE WHEN wdl <> 0.5 THEN CASE WHEN (out > 0) = (wdl > 0.5) THEN 1.0 ELSE 0.0 END END"


@query(
    "sign_agreement",
    f"SELECT file_id, ply, coalesce({r(f'avg({_HIT})')}, 'nan'::DOUBLE) AS accuracy FROM v_pred GROUP BY 1, 2",
    ("v_pred",),
)
def sign_agreement(spark, sf):
    return v_pred(spark, sf).groupBy("file_id", "ply").agg(
        rnd(metrics.sign_agreement(F.col("out"), F.col("wdl"))).alias("accuracy")
    )


@query(
    "holdout_report",
    f"""{_wrm_cte(K)} SELECT {r('avg(err * err)', 9)} AS mean_loss, {r(f'avg({_HIT})', 9)} AS accuracy,
        count(*) AS n_positions, count(*) FILTER (WHERE wdl <> 0.5) AS n_counted FROM e""",
    ("v_pred",),
)
def holdout_report(spark, sf):
    rep = metrics.holdout_report(losses.win_rate_loss(v_pred(spark, sf), K))
    return rep.select(rnd(F.col("mean_loss"), 9).alias("mean_loss"), rnd(F.col("accuracy"), 9).alias("accuracy"), "n_positions", "n_counted")


_N = 30


@query(
    "target_schedule",
    f"""s AS (SELECT superbatch AS sb, avg(loss) AS loss FROM v_hist GROUP BY 1),
        x AS (SELECT sb, sb::DOUBLE AS d FROM s)
        SELECT sb AS superbatch,
          0.3::DOUBLE AS blend_constant, {r(f'0.1 + (0.5 - 0.1) / {_N - 1} * (sb - 1)', 9)} AS blend_linear,
          {r(f'(0.1 + (0.5 - 0.1) / {_N - 1} * (sb - 1)) / (CASE WHEN sb = 1 THEN 97.0 ELSE 1.0 END)', 9)} AS blend_warmup,
          {r('CASE WHEN sb <= 10 THEN 0.2 ELSE 0.2 + 0.6 / 19 * (sb - 11) END', 9)} AS blend_sequence,
          {r('CASE WHEN sb > 12 THEN 0.001 * 0.1 ELSE 0.001 END', 9)} AS lr_drop,
          {r('0.001 * pow(0.5, (sb - 1) // 8)', 9)} AS lr_step,
          {r('CASE WHEN sb >= 24 THEN 0.00001 ELSE 0.001 + d / 24 * (0.00001 - 0.001) END', 9)} AS lr_linear,
          {r('CASE WHEN sb >= 24 THEN 0.00001 ELSE 0.001 + (1 - 0.5 * (1 + cos(pi() * d / 24))) * (0.00001 - 0.001) END', 9)} AS lr_cosine,
          {r('CASE WHEN sb >= 24 THEN 0.00001 ELSE 0.001 * pow(0.01, d / 24) END', 9)} AS lr_exponential,
          {r('CASE WHEN sb <= 9 THEN 0.01 + 0.5 * (0.0004 - 0.01) * (1 + cos(pi() * d / 9)) WHEN sb >= 30 THEN 0.0004 / 10000 ELSE 0.0004 / 10000 + 0.5 * (0.01 - 0.0004 / 10000) * (1 + cos(pi() * (d - 9) / 21)) END', 9)} AS lr_one_cycle,
          {r('CASE WHEN sb <= 10 THEN 0.001 ELSE 0.0005 * pow(0.5, (sb - 11) // 5) END', 9)} AS lr_sequence
        FROM x""",
    ("v_hist",),
)
def target_schedule(spark, sf):
    """Schedules as audit columns beside a run's superbatches (batch 3 of each)."""
    sb, batch = F.col("superbatch"), F.lit(3)
    taper = sch.linear_blend(0.1, 0.5, _N)
    curves = {
        "blend_constant": sch.constant(0.3),
        "blend_linear": taper,
        "blend_warmup": sch.with_warmup(taper, 100),
        "blend_sequence": sch.in_sequence(sch.constant(0.2), sch.linear_blend(0.2, 0.8, _N - 10), 10),
        "lr_drop": sch.drop(0.001, 0.1, 12),
        "lr_step": sch.step(0.001, 0.5, 8),
        "lr_linear": sch.linear(0.001, 0.00001, 24),
        "lr_cosine": sch.cosine(0.001, 0.00001, 24),
        "lr_exponential": sch.exponential(0.001, 0.00001, 24),
        "lr_one_cycle": sch.one_cycle(0.01, 0.3, 25.0, 10000.0, _N),
        "lr_sequence": sch.in_sequence(sch.constant(0.001), sch.step(0.0005, 0.5, 5), 10),
    }
    history = ad.v_hist(spark, sf).select("superbatch").distinct()
    return history.select("superbatch", *[rnd(f(sb, batch), 9).alias(n) for n, f in curves.items()])


@query(
    "superbatch_summary",
    f"""{_wrm_cte(K)},
        o AS (SELECT err * err AS loss, (row_number() OVER (ORDER BY file_id, rec_idx) - 1) // 640 AS superbatch_id, 0.0005 * (1 + ply) AS sec FROM e)
        SELECT superbatch_id, count(*) AS n_positions, {r('avg(loss)', 9)} AS mean_loss, {r('count(*) / sum(sec)', 4)} AS pos_per_sec,
               {r('(100 - superbatch_id) * 640 / (count(*) / sum(sec))', 4)} AS eta_seconds
        FROM o GROUP BY 1""",
    ("v_pred",),
)
def superbatch_summary(spark, sf):
    scored = losses.win_rate_loss(v_pred(spark, sf), K).select(
        "file_id", "rec_idx", F.col("sq_err").alias("loss"), F.lit(1).alias("n"), (0.0005 * (1 + F.col("ply"))).alias("seconds")
    )
    s = metrics.superbatch_summary(games.superbatch_assign(scored, 64, 10), 100, 640)
    return s.select(
        "superbatch_id", "n_positions", rnd(F.col("mean_loss"), 9).alias("mean_loss"),
        rnd(F.col("pos_per_sec"), 4).alias("pos_per_sec"), rnd(F.col("eta_seconds"), 4).alias("eta_seconds"),
    )


# ------------------------------------------------------------------------- surveys

_BUCKET_SQL = f"CAST(greatest(least(floor({sig('score / 600.0')} * 9), 8), 0) AS INTEGER)"


def trainer_view(spark, sf):
    """Drop, sample, clamp, bucket: the rows a trainer will see, with their bucket."""
    pos = filters.score_drop(ad.v_pos(spark, sf), DROP)
    pos = filters.band_sample(pos, BANDS, SEED, EPOCH, BETA)
    return with_bucket(filters.score_clamp(pos, CLAMP))


def with_bucket(pos):
    return pos.withColumn("bucket", surveys.score_bucket(sigmoid(F.col("score") / F.lit(600.0)), 9))


def _hist_sql(source: str) -> str:
    return f"""b AS (SELECT CAST(range AS INTEGER) AS bucket, coalesce(c, 0) AS n FROM range(9) LEFT JOIN (SELECT bucket, count(*) AS c FROM {source} GROUP BY 1) ON bucket = range)
        SELECT bucket, n, {r('CASE WHEN (SELECT sum(n) FROM b) > 0 THEN 100.0 * n / (SELECT sum(n) FROM b) ELSE 0.0 END')} AS pct,
               bucket = (SELECT bucket FROM b ORDER BY n DESC, bucket LIMIT 1) AS is_top FROM b"""


@query(
    "bucket_histogram",
    f"""{draws('d', 'v_pos', SEED, str(EPOCH))},
        t AS (SELECT {_BUCKET_SQL} AS bucket FROM (SELECT greatest(least(score, {CLAMP}), -{CLAMP}) AS score FROM d WHERE abs(score) < {DROP} AND u24 < {LIMIT_SQL})),
        {_hist_sql('t')}""",
    ("v_pos",),
)
def bucket_histogram(spark, sf):
    h = surveys.bucket_histogram(trainer_view(spark, sf), 9)
    return h.select("bucket", "n", rnd(F.col("pct")).alias("pct"), "is_top")


@query(
    "bucket_histogram_per_file",
    f"""t AS (SELECT file_id, {_BUCKET_SQL} AS bucket FROM v_pos),
        g AS (SELECT file_id, bucket, count(*) AS n FROM t GROUP BY GROUPING SETS ((file_id, bucket), (bucket)))
        SELECT file_id, bucket, n, {r('100.0 * n / sum(n) OVER (PARTITION BY file_id)')} AS pct FROM g""",
    ("v_pos",),
)
def bucket_histogram_per_file(spark, sf):
    h = surveys.bucket_histogram_per_file(with_bucket(ad.v_pos(spark, sf)))
    return h.select("file_id", "bucket", "n", rnd(F.col("pct")).alias("pct"))


@query(
    "pruned_bucket_survey",
    f"""p AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY file_id, rec_idx) AS rn FROM v_pos WHERE rec_idx >= 2 AND (rec_idx - 2) % 3 = 0) WHERE rn <= 2000),
        {draws('d', 'p', SEED, '0')},
        t AS (SELECT {_BUCKET_SQL} AS bucket FROM d WHERE u24 < {LIMIT_SQL}),
        {_hist_sql('t')}""",
    ("v_pos",),
)
def pruned_bucket_survey(spark, sf):
    """Strided sample, then the trainer's sampling, then the histogram."""
    picked = checks.strided_sample(ad.v_pos(spark, sf), offset=2, stride=3, samples=2000)
    h = surveys.bucket_histogram(with_bucket(filters.band_sample(picked, BANDS, SEED, 0)), 9)
    return h.select("bucket", "n", rnd(F.col("pct")).alias("pct"), "is_top")


_STATS = """count(*) AS n, round(avg(v), 6) + 0.0 AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS p50,
            percentile_disc(0.9) WITHIN GROUP (ORDER BY v) AS p90, percentile_disc(0.99) WITHIN GROUP (ORDER BY v) AS p99, max(v) AS max"""


@query("active_count_stats", f"c AS (SELECT count(*) AS v FROM v_feat GROUP BY pos_id) SELECT {_STATS} FROM c", ("v_feat",))
def active_count_stats(spark, sf):
    nnz = ad.v_feat(spark, sf).groupBy("pos_id").agg(F.count(F.lit(1)).alias("nnz"))
    return surveys.active_count_stats(nnz, "nnz").withColumn("mean", rnd(F.col("mean")))


@query(
    "active_count_histogram",
    "c AS (SELECT count(*) AS v FROM v_feat GROUP BY pos_id) SELECT v AS value, count(*) AS n FROM c GROUP BY 1",
    ("v_feat",),
)
def active_count_histogram(spark, sf):
    """The full non-zero dump of the same counts."""
    nnz = ad.v_feat(spark, sf).groupBy("pos_id").agg(F.count(F.lit(1)).alias("nnz"))
    return surveys.count_histogram(nnz, "nnz")


@query(
    "cumulative_snapshots",
    f"""s AS (SELECT DISTINCT day FROM v_pos), c AS (SELECT s.day AS superbatch, p.ply AS v FROM s JOIN v_pos p ON p.day <= s.day)
        SELECT superbatch, {_STATS} FROM c GROUP BY 1""",
    ("v_pos",),
)
def cumulative_snapshots(spark, sf):
    return surveys.cumulative_snapshots(ad.v_pos(spark, sf), "day", "ply").withColumn("mean", rnd(F.col("mean")))


# ------------------------------------------------------------------------- tensors


@query(
    "weight_saturation",
    f"""a AS (SELECT name, abs(v) AS a, row_number() OVER (PARTITION BY name ORDER BY abs(v)) - 1 AS rk, count(*) OVER (PARTITION BY name) AS n FROM v_tensor)
        SELECT name, max(n) AS n, {r('max(a)')} AS max, {r('max(CASE WHEN rk = floor((n - 1) * 0.99::DOUBLE) THEN a END)')} AS p99,
               {r('max(CASE WHEN rk = floor((n - 1) * 0.999::DOUBLE) THEN a END)')} AS p999,
               {r('100.0 * count(*) FILTER (WHERE a >= 0.25 * 0.9) / count(*)')} AS near_pct,
               {r('100.0 * count(*) FILTER (WHERE a >= 0.25 - 0.25 * 1e-5) / count(*)')} AS at_pct FROM a GROUP BY 1""",
    ("v_tensor",),
)
def weight_saturation(spark, sf):
    s = tensors.weight_saturation(ad.v_tensor(spark, sf), 0.25)
    return s.select("name", "n", *[rnd(F.col(c)).alias(c) for c in ("max", "p99", "p999", "near_pct", "at_pct")])


_Q8 = "CAST(greatest(least(round(v * 8 * 64.0), 127), -128) AS INTEGER)"


@query(
    "quantised_endpoint_stats",
    f"""q AS (SELECT name, {_Q8} AS q FROM v_tensor)
        SELECT name, count(*) AS total, count(*) FILTER (WHERE q = 127) AS positive_127, count(*) FILTER (WHERE q = -127) AS negative_127,
               count(*) FILTER (WHERE q = -128) AS negative_128, {r('100.0 * count(*) FILTER (WHERE abs(q) = 127) / count(*)')} AS pinned_pct,
               {r('100.0 * count(*) FILTER (WHERE abs(q) >= 127) / count(*)')} AS saturated_pct FROM q GROUP BY 1""",
    ("v_tensor",),
)
def quantised_endpoint_stats(spark, sf):
    t = ad.v_tensor(spark, sf).withColumn("v", F.col("v") * 8)
    s = tensors.quantised_endpoint_stats(t)
    return s.withColumns({"pinned_pct": rnd(F.col("pinned_pct")), "saturated_pct": rnd(F.col("saturated_pct"))})


@query(
    "tensor_diff",
    f"""t AS (SELECT name, v AS a, {_Q8} / 512.0::DOUBLE AS b FROM v_tensor)
        SELECT name, count(*) AS n_a, count(*) AS n_b, CAST(0 AS BIGINT) AS n_unmatched, {r('100.0 * count(*) FILTER (WHERE abs(a - b) > 1e-9) / count(*)')} AS diff_pct,
               {r('max(abs(a - b))')} AS max_abs, {r('avg(abs(a - b))', 9)} AS mean_abs, {r('sqrt(avg((a - b) * (a - b)))', 9)} AS rmse,
               {r('sqrt(sum(a * a))')} AS norm_a, {r('sqrt(sum(b * b))')} AS norm_b, {r('sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))', 9)} AS cosine
        FROM t GROUP BY 1""",
    ("v_tensor",),
)
def tensor_diff(spark, sf):
    """A tensor against its quantised and restored self."""
    a = ad.v_tensor(spark, sf)
    b = a.withColumn("v", tensors.quantise(F.col("v") * 8, 64.0, -128, 127) / F.lit(512.0))
    d = tensors.tensor_diff(a, b)
    return d.select(
        "name", "n_a", "n_b", "n_unmatched",
        *[rnd(F.col(c)).alias(c) for c in ("diff_pct", "max_abs", "norm_a", "norm_b")],
        *[rnd(F.col(c), 9).alias(c) for c in ("mean_abs", "rmse", "cosine")],
    )


_WIDTHS = "(VALUES " + ", ".join(f"({i}, {w})" for i, w in enumerate(dims.class_widths())) + ") AS cw(ac, width)"
_NAMES = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(dims.CLASS_NAMES)) + ") AS cn(ac, key)"
PAIRS_SQL = f"""
  SELECT attacker_side, ac, attacked_side, dc, width,
         coalesce(sum(width) OVER (ORDER BY attacker_side, ac, attacked_side, dc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM {_WIDTHS}, (SELECT range AS attacker_side FROM range(2)), (SELECT range AS attacked_side FROM range(2)), (SELECT range AS dc FROM range(9))"""
ad.add_view("v_pairs", PAIRS_SQL)
_DIMS = 4 * 9 * sum(dims.class_widths())
#: The tensor as blocks of the profile's size: element ``idx`` is row ``idx mod size`` of block ``idx div size``.
_ROWS = f"""p AS (SELECT t.idx, attacker_side AS a_s, attacked_side AS d_s, v_pairs.ac, dc, v FROM v_tensor t JOIN v_pairs ON t.idx % {_DIMS} >= base AND t.idx % {_DIMS} < base + width)"""


def _folded(spark, sf):
    """The tensor with ``idx`` inside the profile, and its own number as ``element``."""
    return ad.v_tensor(spark, sf).withColumns({"element": F.col("idx"), "idx": F.col("idx") % _DIMS})
_SLIDE = "ac IN (1, 5, 6, 7, 8)"


@query(
    "pair_norm_breakdown",
    f"""{_ROWS}, x AS (
          SELECT 'total' AS axis, 'all' AS key, sum(v * v) AS l2sq FROM p
          UNION ALL SELECT 'class', key, sum(v * v) FROM p JOIN {_NAMES} USING (ac) GROUP BY 2
          UNION ALL SELECT 'side', CASE WHEN a_s = d_s THEN 'defense' ELSE 'attack' END, sum(v * v) FROM p GROUP BY 2
          UNION ALL SELECT 'reach', CASE WHEN {_SLIDE} THEN 'slider' ELSE 'step' END, sum(v * v) FROM p GROUP BY 2
          UNION ALL SELECT 'pair', CASE WHEN ac = dc THEN 'same-class' ELSE 'cross-class' END, sum(v * v) FROM p GROUP BY 2),
        s AS (SELECT 'class' AS axis, key, CAST(sum(width) AS BIGINT) AS dims FROM v_pairs JOIN {_NAMES} USING (ac) GROUP BY 2)
        SELECT axis, key, {r('l2sq')} AS l2sq, dims, {r('l2sq / dims', 9)} AS per_dim FROM x LEFT JOIN s USING (axis, key)""",
    ("v_tensor", "v_pairs"),
)
def pair_norm_breakdown(spark, sf):
    b = tensors.pair_norm_breakdown(_folded(spark, sf), 1, "full")
    return b.select("axis", "key", rnd(F.col("l2sq")).alias("l2sq"), "dims", rnd(F.when(F.col("dims").isNotNull(), F.col("per_dim")), 9).alias("per_dim"))


@query(
    "ablate_rows",
    f"""{_ROWS}
        SELECT CAST(idx AS BIGINT) AS idx, NOT ({_SLIDE}) AS zeroed, {r(f'CASE WHEN {_SLIDE} THEN v ELSE 0.0 END', 9)} AS v FROM p""",
    ("v_tensor", "v_pairs"),
)
def ablate_rows(spark, sf):
    t = tensors.ablate_rows(_folded(spark, sf), 1, "full", "step-attacker")
    return t.select(F.col("element").alias("idx"), "zeroed", rnd(F.col("v"), 9).alias("v"))


@query(
    "ablate_rows_random",
    f"""n AS (SELECT range AS row FROM range({_DIMS})), {draws('d', 'n', 7, '0', 'row')},
        k AS (SELECT row FROM d ORDER BY u24, row LIMIT 40000)
        SELECT name, count(*) FILTER (WHERE row IS NOT NULL) AS zeroed, {r('sum(CASE WHEN row IS NULL THEN v * v ELSE 0.0 END)')} AS l2sq
        FROM v_tensor LEFT JOIN k ON row = idx % {_DIMS} GROUP BY 1""",
    ("v_tensor",),
)
def ablate_rows_random(spark, sf):
    t = tensors.ablate_rows(_folded(spark, sf), 1, "full", "random:7:40000")
    return t.groupBy("name").agg(F.count_if("zeroed").alias("zeroed"), rnd(F.sum(F.col("v") * F.col("v"))).alias("l2sq"))


_SPECS = {
    "all": "true", "slider-attacker": _SLIDE, "step-attacker": f"NOT ({_SLIDE})", "bigslider-attacker": "ac IN (5, 6, 7, 8)",
    "defense": "a_s = d_s", "attack": "a_s <> d_s", "same-class": "ac = dc",
}


@query(
    "ablate_rows_specs",
    f"{_ROWS} " + " UNION ALL ".join(
        f"""SELECT '{s}' AS spec, count(*) FILTER (WHERE {c}) AS zeroed, {r(f'sum(CASE WHEN {c} THEN 0.0 ELSE v * v END)')} AS l2sq FROM p""" for s, c in _SPECS.items()
    ),
    ("v_tensor", "v_pairs"),
)
def ablate_rows_specs(spark, sf):
    """What each named spec zeroes and leaves of the tensor."""
    parts = [
        tensors.ablate_rows(_folded(spark, sf), 1, "full", s).agg(
            F.lit(s).alias("spec"), F.count_if("zeroed").alias("zeroed"), rnd(F.sum(F.col("v") * F.col("v"))).alias("l2sq")
        )
        for s in tensors.ABLATIONS
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "ablation_report",
    f"""p AS (SELECT q.attacker_side AS a_s, q.attacked_side AS d_s, q.ac, q.dc, q.width, count(t.v) AS n, sum(t.v * t.v) AS ss
              FROM v_pairs q LEFT JOIN v_tensor t ON t.idx % {_DIMS} >= base AND t.idx % {_DIMS} < base + width GROUP BY ALL) """ + " UNION ALL ".join(
        f"""SELECT '{s}' AS spec, CAST(sum(width) AS BIGINT) AS dims, count(*) AS pairs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_values, {r('coalesce(sum(ss), 0)')} AS l2sq
            FROM p WHERE {c}""" for s, c in _SPECS.items()
    ),
    ("v_tensor", "v_pairs"),
)
def ablation_report(spark, sf):
    """Per spec: feature rows and pairs it covers, and the tensor's values and squares there."""
    rep = tensors.ablation_report(_folded(spark, sf), 1, "full")
    return rep.withColumn("l2sq", rnd(F.col("l2sq")))

@query(
    "group_norm_correction",
    f"""g AS (SELECT name, idx % 64 AS o, sqrt(sum(v * v)) AS norm FROM v_tensor GROUP BY 1, 2)
        SELECT t.name, t.idx, {r('norm')} AS norm, {r('v * (1 - 0.5 * (0.02 * (1 - 1 / (norm + 1e-8))))', 9)} AS v
        FROM v_tensor t JOIN g ON t.name = g.name AND t.idx % 64 = g.o""",
    ("v_tensor",),
)
def group_norm_correction(spark, sf):
    t = tensors.group_norm_correction(ad.v_tensor(spark, sf), F.struct("name", (F.col("idx") % 64).alias("o")), 0.5, 0.01)
    return t.select("name", "idx", rnd(F.col("norm")).alias("norm"), rnd(F.col("v"), 9).alias("v"))


_VROW = "((idx // 4) % 97) * 4 + idx % 4"


@query("shared_row_reduce", f"SELECT {_VROW} AS vrow, 0 AS out, {r('sum(v)')} AS g FROM v_tensor GROUP BY 1", ("v_tensor",))
def shared_row_reduce(spark, sf):
    t = ad.v_tensor(spark, sf).select(F.col("idx").alias("feature"), F.lit(0).alias("out"), F.col("v").alias("g"))
    out = tensors.shared_row_reduce(t, tensors.virtual_row(F.col("feature"), 97, 4, "per-bucket"))
    return out.select("vrow", "out", rnd(F.col("g")).alias("g"))


@query(
    "shared_row_fold",
    f"""g AS (SELECT (idx // 4) % 97 AS vrow, avg(v) AS vv FROM v_tensor GROUP BY 1)
        SELECT idx AS feature, g.vrow, {r('v + vv', 9)} AS v FROM v_tensor JOIN g ON (idx // 4) % 97 = g.vrow""",
    ("v_tensor",),
)
def shared_row_fold(spark, sf):
    t = ad.v_tensor(spark, sf).select(F.col("idx").alias("feature"), F.lit(0).alias("out"), "v")
    vrow = tensors.virtual_row(F.col("feature"), 97, 4, "pool")
    virtual = t.groupBy(vrow.alias("vrow"), "out").agg(F.avg("v").alias("vv"))
    return tensors.shared_row_fold(t, virtual, vrow).select("feature", "vrow", rnd(F.col("v"), 9).alias("v"))


# ------------------------------------------------------------------------- runs


@query(
    "run_best",
    f"""a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, superbatch) AS rl,
                    row_number() OVER (PARTITION BY run ORDER BY test_loss NULLS LAST, superbatch) AS rt FROM v_hist)
        SELECT l.run, {r('l.loss')} AS best_loss, l.superbatch AS best_loss_superbatch, {r('t.test_loss')} AS best_test_loss,
               CASE WHEN t.test_loss IS NOT NULL THEN t.superbatch END AS best_test_loss_superbatch
        FROM a l JOIN a t ON l.run = t.run AND t.rt = 1 WHERE l.rl = 1""",
    ("v_hist",),
)
def run_best(spark, sf):
    b = runs.run_best(runs.recorded_history(ad.v_hist(spark, sf)))
    return b.withColumns({"best_loss": rnd(F.col("best_loss")), "best_test_loss": rnd(F.col("best_test_loss"))})


@query(
    "run_throughput",
    f"""SELECT run, CAST(sum(n_positions) AS BIGINT) AS total_positions, CAST(round(sum(seconds)) AS BIGINT) AS training_time_seconds,
               CAST(CASE WHEN sum(seconds) > 0 THEN round(sum(n_positions) / sum(seconds)) ELSE 0 END AS BIGINT) AS mean_pos_per_sec,
               {r('sum(n_positions) / 500.0')} AS dataset_passes FROM v_hist GROUP BY 1""",
    ("v_hist",),
)
def run_throughput(spark, sf):
    return runs.run_throughput(ad.v_hist(spark, sf), 500).withColumn("dataset_passes", rnd(F.col("dataset_passes")))


@query(
    "run_lineage",
    """x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey // 2 END AS pid, o_orderpriority AS checkpoint, CAST(dayofyear(o_orderdate) AS INTEGER) AS superbatch FROM orders)
       SELECT c.id, p.id AS parent_id, p.checkpoint AS resumed_from_checkpoint, p.superbatch AS resumed_from_superbatch
       FROM x c LEFT JOIN x p ON c.pid = p.id WHERE c.pid IS NOT NULL""",
)
def run_lineage(spark, sf):
    """Orders as runs; two of three resume the order with half their key."""
    o = ad.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey div 2 END").alias("parent_id"),
        F.col("o_orderpriority").alias("checkpoint"),
        F.dayofyear("o_orderdate").alias("superbatch"),
    )
    return runs.run_lineage(o)


def v_bench(spark, sf):
    """Throughput per (case, run, superbatch) from daily event values."""
    return (
        ad.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("case_id"), (F.col("user_id") % 4).cast("int").alias("run"), ad.day_number("ts").alias("superbatch"))
        .agg(F.avg("value").alias("pos_per_sec"))
    )


ad.add_view(
    "v_bench",
    f"SELECT event_type AS case_id, CAST(user_id % 4 AS INTEGER) AS run, {ad._DAY} AS superbatch, avg(value) AS pos_per_sec FROM events GROUP BY 1, 2, 3",
)


@query(
    "bench_summary",
    f"""m AS (SELECT case_id, run, avg(pos_per_sec) AS m FROM v_bench WHERE superbatch > 1 GROUP BY 1, 2)
        SELECT case_id, count(*) AS n_runs, {r('avg(m)')} AS mean, {r('median(m)')} AS median, {r('coalesce(stddev_samp(m), 0)')} AS sample_sd,
               {r('min(m)')} AS min, {r('max(m)')} AS max, {r('100.0 * coalesce(stddev_samp(m), 0) / avg(m)')} AS cv_pct FROM m GROUP BY 1""",
    ("v_bench",),
)
def bench_summary(spark, sf):
    s = runs.bench_summary(v_bench(spark, sf), 1)
    return s.select("case_id", "n_runs", *[rnd(F.col(c)).alias(c) for c in ("mean", "median", "sample_sd", "min", "max", "cv_pct")])


@query(
    "bench_paired_delta",
    f"""d AS (SELECT superbatch % 2 AS grp, superbatch AS run, avg(CASE WHEN run = 'view' THEN loss END) AS a, avg(CASE WHEN run = 'click' THEN loss END) AS b
              FROM v_hist WHERE run IN ('view', 'click') GROUP BY 1, 2)
        SELECT grp, count(b / a) AS n_pairs, {r('avg((b / a - 1) * 100)')} AS mean_delta_pct, {r('coalesce(stddev_samp((b / a - 1) * 100), 0)')} AS sd_delta_pct,
               {r('avg(b) / avg(a)')} AS ratio FROM d GROUP BY 1""",
    ("v_hist",),
)
def bench_paired_delta(spark, sf):
    h = ad.v_hist(spark, sf).select(
        (F.col("superbatch") % 2).alias("grp"), F.col("run").alias("backend"), F.col("superbatch").alias("run"), F.col("loss").alias("pos_per_sec")
    )
    d = runs.bench_paired_delta(h, "view", "click")
    return d.select("grp", "n_pairs", *[rnd(F.col(c)).alias(c) for c in ("mean_delta_pct", "sd_delta_pct", "ratio")])


@query(
    "precision_speedup",
    f"""SELECT superbatch % 2 AS grp, {r("avg(CASE WHEN run = 'purchase' THEN loss END) / avg(CASE WHEN run = 'signup' THEN loss END)")} AS speedup
        FROM v_hist GROUP BY 1""",
    ("v_hist",),
)
def precision_speedup(spark, sf):
    h = ad.v_hist(spark, sf).select((F.col("superbatch") % 2).alias("grp"), F.col("run").alias("precision"), F.col("loss").alias("pos_per_sec"))
    return runs.precision_speedup(h, "signup", "purchase").withColumn("speedup", rnd(F.col("speedup")))


@query(
    "bench_completeness",
    """h AS (SELECT run, superbatch, loss FROM v_hist WHERE (superbatch + length(run)) % 7 <> 0 OR superbatch = 30 UNION ALL SELECT run, superbatch, loss FROM v_hist WHERE superbatch = length(run)),
       c AS (SELECT run, superbatch, count(*) AS n FROM h GROUP BY 1, 2),
       m AS (SELECT run, CAST(28 - count(*) FILTER (WHERE superbatch <= 28) AS BIGINT) AS missing,
                    CAST(sum(CASE WHEN superbatch <= 28 THEN n - 1 ELSE n END) AS BIGINT) AS extra FROM c GROUP BY 1),
       b AS (SELECT run, count(*) FILTER (WHERE NOT (isfinite(loss) AND loss > 0)) AS bad_values FROM h GROUP BY 1)
       SELECT run, missing, extra, bad_values, missing = 0 AND extra = 0 AND bad_values = 0 AS complete FROM m JOIN b USING (run)""",
    ("v_hist",),
)
def bench_completeness(spark, sf):
    """Histories with gaps and repeats: superbatches must be exactly 1..28."""
    h = ad.v_hist(spark, sf).select("run", "superbatch", F.col("loss").alias("pos_per_sec"))
    gaps = h.where(((F.col("superbatch") + F.length("run")) % 7 != 0) | (F.col("superbatch") == 30))
    repeats = h.where(F.col("superbatch") == F.length("run"))
    return runs.bench_completeness(gaps.unionByName(repeats), 28)
