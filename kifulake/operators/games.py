"""Game segmentation, game-relative labels, holdouts and batch assignment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import epoch_term
from .ordering import BLOCK_ROWS, block_manifest, block_of, with_ordinal


def segment_games(
    df: DataFrame,
    file_col: str = "file_id",
    idx_col: str = "rec_idx",
    ply_col: str = "ply",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``game_seq``: games numbered from 0 across files in order.

    A game starts at a file's first record and wherever ``ply <= previous ply``. Inside a
    block the previous ply comes from a window; across blocks from the manifest. The block
    summary reads the window's output, so rows are shuffled once (the exchange is shared).
    A NULL ply (formats that do not store one) is refused at run time.
    """
    ply = F.col(ply_col)
    checked = F.when(ply.isNull(), F.raise_error(F.lit("segment_games needs a ply column"))).otherwise(ply)
    rows = df.withColumns({"_blk": block_of(idx_col, block_rows), "_ply": checked.cast("int")})
    in_block = Window.partitionBy(file_col, "_blk").orderBy(idx_col)
    rows = rows.withColumn("_prev", F.lag("_ply").over(in_block))
    rows = rows.withColumn("_start", F.when(F.col("_ply") <= F.col("_prev"), 1).otherwise(0))
    rows = rows.withColumn(
        "_run", F.sum("_start").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    )
    manifest = rows.groupBy(file_col, "_blk").agg(
        F.max_by("_ply", idx_col).alias("_last"),
        F.min_by("_ply", idx_col).alias("_first"),
        F.sum("_start").alias("_inner"),
    )
    blocks = Window.partitionBy(file_col).orderBy("_blk")
    manifest = manifest.withColumn("_carry", F.lag("_last").over(blocks)).withColumn(
        "_head", F.when(F.col("_carry").isNull() | (F.col("_first") <= F.col("_carry")), 1).otherwise(0)
    )
    earlier = Window.orderBy(file_col, "_blk").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.select(
        file_col,
        "_blk",
        # games begun before this block, plus this block's own head start, minus one
        (F.coalesce(F.sum(F.col("_inner") + F.col("_head")).over(earlier), F.lit(0)) + F.col("_head") - 1)
        .cast("bigint")
        .alias("_base"),
    )
    return (
        rows.join(manifest, [file_col, "_blk"])
        .withColumn("game_seq", F.col("_base") + F.col("_run"))
        .drop("_blk", "_ply", "_prev", "_start", "_run", "_base")
    )


def with_game_targets(df: DataFrame, idx_col: str = "rec_idx") -> DataFrame:
    """Add ``game_len``, ``i`` (0-based index in the game) and ``target = i / (len - 1)``.

    Plies rise strictly inside a game and are 16-bit, so a game window has a fixed bound.
    """
    game = Window.partitionBy("game_seq")
    out = df.withColumns(
        {
            "i": F.row_number().over(game.orderBy(idx_col)).cast("bigint") - 1,
            "game_len": F.count(F.lit(1)).over(game),
        }
    )
    target = F.when(F.col("game_len") > 1, F.col("i") / (F.col("game_len") - 1)).otherwise(0.0)
    return out.withColumn("target", target)


def holdout_stride(fraction: float) -> int | None:
    """Every how many games one goes to validation; None when the fraction is 0."""
    if not 0.0 <= fraction <= 0.5:
        raise ValueError("holdout fraction must be in 0..0.5")
    return math.floor(1.0 / fraction + 0.5) if fraction > 0 else None


def route_games(df: DataFrame, fraction: float, games_per_step: int, max_games: int = 0) -> DataFrame:
    """Add ``is_val`` and ``step_id`` from ``game_seq``.

    Training games keep their order, and every stride-th game is validation, so the training
    number follows from ``game_seq`` by arithmetic: no window, no shuffle. The same holds for
    validation games; each side fills its own steps. ``max_games`` caps both sides together.
    """
    if max_games:
        df = df.where(F.col("game_seq") < max_games)
    seq = F.col("game_seq")
    stride = holdout_stride(fraction)
    if stride is None:
        return df.withColumns(
            {"is_val": F.lit(False), "side_seq": seq, "step_id": F.expr(f"game_seq div {games_per_step}")}
        )
    val_before = F.expr(f"(game_seq + {stride - 1}) div {stride}")
    df = df.withColumn("is_val", seq % stride == 0)
    df = df.withColumn("side_seq", F.when(F.col("is_val"), F.expr(f"game_seq div {stride}")).otherwise(seq - val_before))
    return df.withColumn("step_id", F.expr(f"side_seq div {games_per_step}"))


def with_position_norm(df: DataFrame, games_per_step: int) -> DataFrame:
    """Add ``norm = 1 / (game_len * games in the step)`` (after :func:`route_games`).

    Every step but a side's last is full, so its game count needs only the number of games
    per side: two rows, whatever the corpus.
    """
    sides = df.groupBy("is_val").agg((F.max("side_seq") + 1).alias("_side_games"))
    out = df.join(F.broadcast(sides), "is_val")
    n_games = F.least(F.lit(games_per_step), F.col("_side_games") - F.col("step_id") * games_per_step)
    return out.withColumn("norm", F.lit(1.0) / (F.col("game_len") * n_games)).drop("_side_games")


def tail_split(df: DataFrame, holdout: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``split``: the last ``holdout`` records in order are 'holdout', the rest 'train'.

    Fails when nothing is left to train on. The manifest decides whole blocks; only the block that
    the boundary runs through is put in order.
    """
    rows = df.withColumn("_blk", block_of("rec_idx", block_rows))
    cut = F.col("_total") - holdout
    empty = F.raise_error(F.lit("tail split leaves no training records"))
    side = F.when(F.col("_total") <= holdout, empty).when(F.col("_before") >= cut, "holdout").when(F.col("_before") + F.col("_n") <= cut, "train")
    rows = rows.join(block_manifest(rows, "file_id"), ["file_id", "_blk"]).withColumn("split", side)
    decided, split = rows.where(F.col("split").isNotNull()), rows.where(F.col("split").isNull())
    in_block = Window.partitionBy("file_id", "_blk").orderBy("rec_idx")
    place = F.col("_before") + F.row_number().over(in_block) - 1
    split = split.withColumn("_ord", place).withColumn("split", F.when(F.col("_ord") >= cut, "holdout").otherwise("train")).drop("_ord")
    return decided.unionByName(split).drop("_blk", "_n", "_before", "_total")


def fixed_holdout(
    df: DataFrame, positions: int, batch_size: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The first full batches covering ``positions`` rows, with ``batch_id``.

    ``df`` is already score-filtered. A partial batch is dropped; fewer than one full batch
    is an error.
    """
    want = max(math.ceil(positions / batch_size), 1) * batch_size
    rows = with_ordinal(df, out="_ord", block_rows=block_rows, first=want, total="_total")
    usable = F.expr(f"(least(_total, {want}L) div {batch_size}) * {batch_size}")
    short = F.raise_error(F.lit("holdout needs at least one full batch")).cast("bigint")
    limit = F.when(F.col("_total") < batch_size, short).otherwise(usable)
    return (
        rows.where(F.col("_ord") < limit)
        .withColumn("batch_id", F.expr(f"_ord div {batch_size}"))
        .drop("_ord", "_total")
    )


def epoch_expand(df: DataFrame, epochs: int) -> DataFrame:
    """Repeat the rows once per epoch, with ``epoch`` and its hash term ``epoch_term``."""
    passes = F.array(
        *[F.struct(F.lit(e).alias("epoch"), F.lit(epoch_term(e)).cast("bigint").alias("epoch_term")) for e in range(epochs)]
    )
    return df.withColumn("_pass", F.explode(passes)).select("*", "_pass.epoch", "_pass.epoch_term").drop("_pass")


def superbatch_assign(
    df: DataFrame, batch_size: int, batches_per_superbatch: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut the ordered stream into batches and superbatches (both numbered from 0)."""
    rows = with_ordinal(df, out="_ord", block_rows=block_rows)
    return rows.withColumns(
        {
            "batch_id": F.expr(f"_ord div {batch_size}"),
            "superbatch_id": F.expr(f"_ord div {batch_size * batches_per_superbatch}"),
        }
    ).drop("_ord")
