"""Order-dependent building blocks that never put a whole file in one task.

Records are ordered by ``(file_id, rec_idx)``. A file may hold any share of the corpus, so
nothing here windows over a file's rows. Rows are cut into blocks of consecutive record
indices; work inside a block is a window over at most ``block_rows`` rows, and what crosses
blocks is carried by a manifest with one row per block (2^20 records each by default, so
100 TB of 40-byte records make about 2.6 million manifest rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20


def block_of(idx: str, block_rows: int) -> Column:
    """Integer division of a record index by the block size."""
    return F.expr(f"`{idx}` div {block_rows}")


def block_manifest(rows: DataFrame, file_col: str) -> DataFrame:
    """One row per (file, ``_blk``): its rows ``_n``, those before it ``_before``, and ``_total``."""
    manifest = rows.groupBy(file_col, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy(file_col, "_blk")
    return manifest.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_total": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )


def with_ordinal(
    df: DataFrame,
    file_col: str = "file_id",
    idx_col: str = "rec_idx",
    out: str = "ordinal",
    within_file: str | None = None,
    block_rows: int = BLOCK_ROWS,
    first: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in ``(file, index)`` order over all files.

    ``within_file`` names a second column for the position inside the row's own file, ``total`` one
    for the number of all rows. ``first`` keeps the first so many rows: the manifest says which blocks
    hold them, and only these are shuffled. The rows are shuffled once, by (file, block); the
    manifest is the only global sort.
    """
    rows = df.withColumn("_blk", block_of(idx_col, block_rows))
    manifest = block_manifest(rows, file_col)
    if first is not None:
        manifest = manifest.where(F.col("_before") < first)
    if within_file:
        per_file = Window.partitionBy(file_col)
        manifest = manifest.withColumn("_file_start", F.min("_before").over(per_file))
    in_block = Window.partitionBy(file_col, "_blk").orderBy(idx_col)
    rows = rows.join(manifest.drop("_n"), [file_col, "_blk"])
    rows = rows.withColumn("_pos", F.row_number().over(in_block).cast("bigint") - 1)
    rows = rows.withColumn(out, F.col("_before") + F.col("_pos"))
    if first is not None:
        rows = rows.where(F.col(out) < first)
    rows = rows.withColumnRenamed("_total", total) if total else rows.drop("_total")
    if within_file:
        rows = rows.withColumn(within_file, F.col(out) - F.col("_file_start")).drop("_file_start")
    return rows.drop("_blk", "_pos", "_before")


CELLS_PER_OCTAVE = 4096


def magnitude_cell(a: Column) -> Column:
    """A bounded, monotone cell number of a non-negative value (zero gets its own cell).

    An octave of float32 values has 2^23 members, so a cell holds at most 2^11 of them; doubles that are
    not float32 values may be more, and then a cell is as large as its distinct values.
    """
    return F.when(a > 0, F.floor(F.log2(a) * F.lit(CELLS_PER_OCTAVE))).otherwise(
        F.lit(-(1 << 40)).cast("bigint")
    )


def select_ranks(df: DataFrame, group: str, value: str, ranks: dict[str, Column], count: str | None = None) -> DataFrame:
    """Exact order statistics of ``value`` (non-negative) per ``group``.

    ``ranks`` maps an output name to a 0-based rank expression over ``n`` (the group size).
    Values are pre-aggregated map-side (or are already, with their number in ``count``); the search narrows to one cell per rank, so no group
    is ever sorted whole.
    """
    if count:
        counts = df.select(group, F.col(value).alias("_a"), F.col(count).alias("_c"))
    else:
        counts = df.groupBy(group, F.col(value).alias("_a")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_cell", magnitude_cell(F.col("_a")))
    cells = counts.groupBy(group, "_cell").agg(F.sum("_c").alias("_cc"))
    ordered = Window.partitionBy(group).orderBy("_cell")
    cells = cells.withColumns(
        {
            "_upto": F.sum("_cc").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
            "n": F.sum("_cc").over(Window.partitionBy(group)),
        }
    )
    wanted = F.explode(
        F.array(*[F.struct(F.lit(k).alias("name"), c.cast("bigint").alias("rank")) for k, c in ranks.items()])
    )
    targets = (
        cells.select(group, "_cell", "_cc", "_upto", "n", wanted.alias("q"))
        .where((F.col("q.rank") < F.col("_upto")) & (F.col("q.rank") >= F.col("_upto") - F.col("_cc")))
        .select(
            group,
            "_cell",
            "n",
            F.col("q.name").alias("_name"),
            (F.col("q.rank") - (F.col("_upto") - F.col("_cc"))).alias("_inner"),
        )
    )
    inside = Window.partitionBy(group, "_cell", "_name").orderBy("_a")
    hits = (
        counts.join(targets, [group, "_cell"])
        .withColumn("_run", F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("_run") > F.col("_inner")) & (F.col("_run") - F.col("_c") <= F.col("_inner")))
    )
    return hits.groupBy(group).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("_name") == k, F.col("_a"))).alias(k) for k in ranks],
    )
