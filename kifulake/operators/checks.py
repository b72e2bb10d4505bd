"""Corpus-level comparison, sampling and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..session import materialise
from .ordering import BLOCK_ROWS, with_ordinal


def strided_sample(
    df: DataFrame, offset: int, stride: int, samples: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One of every ``stride`` records from ``offset`` on, at most ``samples`` over all files.

    The cap counts in (file, index) order and is applied by position, not by a sort in one
    task, so it may be as large as the caller likes; blocks past it are not shuffled.
    """
    i = F.col("rec_idx")
    picked = df.where((i >= offset) & ((i - offset) % stride == 0))
    return with_ordinal(picked, out="_ord", block_rows=block_rows, first=samples).drop("_ord")


def tag_files(rows: DataFrame, path: str, files: list[str]) -> DataFrame:
    """One scan over all files as one table, with each file's place in ``files`` as ``file_id``.

    ``path`` names a row's file (``_metadata.file_path`` of a scan). A file not listed is an error.
    """
    order = F.array(*[F.lit(f) for f in files])
    place = F.array_position(order, F.col(path))
    missing = F.raise_error(F.concat(F.lit("file not listed: "), F.col(path))).cast("int")
    return rows.withColumn("file_id", F.when(place > 0, (place - 1).cast("int")).otherwise(missing))


#: Differing blocks up to this many are sent to every task; more of them meet the records in a shuffled join.
SENT_BLOCKS = 1 << 16


def _digests(side: DataFrame, key: str, fields: list[str], block_rows: int) -> DataFrame:
    """(block, n, digest): per block of keys its records and two 64-bit hash sums, in 32-bit halves that cannot overflow."""
    parts = [F.col(key), *[F.col(f) for f in fields], *[F.col(f).isNull() for f in fields]]  # a hash skips nulls
    h = F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)
    halves = [F.sum(half) for x in h for half in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]
    block = F.floor(F.col(key) / F.lit(block_rows)).alias("block")
    return side.groupBy(block).agg(F.count(F.lit(1)).alias("n"), F.array(*halves).alias("digest"))


def block_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, n_left, n_right, same): blocks of ``block_rows`` keys and whether both sides hold the same records there.

    Both sides are read once and reduced to one row per block before anything is shuffled.
    """
    a = _digests(left, key, fields, block_rows).withColumnsRenamed({"n": "n_left", "digest": "_a"})
    b = _digests(right, key, fields, block_rows).withColumnsRenamed({"block": "_block", "n": "n_right", "digest": "_b"})
    both = a.join(b, F.col("block").eqNullSafe(F.col("_block")), "full_outer")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    same = F.col("_a").eqNullSafe(F.col("_b")) & F.col("n_left").eqNullSafe(F.col("n_right")) & F.col("block").isNotNull()
    return both.select(F.coalesce("block", "_block").alias("block"), count("n_left"), count("n_right"), same.alias("same"))


def differing_records(side: DataFrame, blocks: DataFrame, key: str, block_rows: int = BLOCK_ROWS, sent: int = SENT_BLOCKS) -> DataFrame:
    """The records of ``side`` in ``blocks`` (those that differ). Up to ``sent`` blocks the records of other blocks are not shuffled."""
    wanted = blocks.select("block")
    wanted = F.broadcast(wanted) if wanted.limit(sent + 1).count() <= sent else wanted
    return side.join(wanted, F.floor(F.col(key) / F.lit(block_rows)).eqNullSafe(F.col("block")), "left_semi")


def crosscheck(left: DataFrame, right: DataFrame, key: str, fields: list[str], block_rows: int = BLOCK_ROWS, sent: int = SENT_BLOCKS) -> DataFrame:
    """Counts of records on one side only and of differing fields, null-safe, in one row.

    ``key`` is a number, unique on each side; records without one are on their side only. Sides are compared by
    :func:`block_differences` first, and only the records of differing blocks are joined.
    """
    blocks = materialise(block_differences(left, right, key, fields, block_rows), "blocks")
    apart = blocks.where(~F.col("same"))
    a, b = (differing_records(side, apart, key, block_rows, sent) for side in (left, right))
    a = a.select(F.col(key).alias("_k"), F.lit(True).alias("_l"), *[F.col(f).alias(f"_l_{f}") for f in fields])
    b = b.select(F.col(key).alias("_k"), F.lit(True).alias("_r"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    found = a.join(b, "_k", "full_outer").agg(
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
        *[F.count_if(both & ~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}"))).alias(f"diff_{f}") for f in fields],
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sizes = blocks.agg(total("n_left"), total("n_right"))
    return sizes.crossJoin(found)  # one row each


def quality_report(positions: DataFrame) -> DataFrame:
    """Range rules of a position corpus, counted in one pass."""
    on_board = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < 81), F.lit(False))
    return positions.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ply") > 1024).alias("bad_ply"),
        F.count_if(scores.magnitude(F.col("score")) > 32600).alias("bad_score"),
        F.count_if(~F.col("result").between(-1, 1)).alias("bad_result"),
        F.count_if(~(on_board("bk_sq") & on_board("wk_sq"))).alias("bad_kings"),
    )
