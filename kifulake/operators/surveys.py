"""Histograms, count statistics and their per-file and cumulative forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise


def score_bucket(progress: Column, n: int) -> Column:
    """``clamp(floor(p * n), 0, n - 1)`` for 1 <= n <= 256."""
    if not 1 <= n <= 256:
        raise ValueError("bucket count must be in 1..256")
    return F.greatest(F.least(F.floor(progress * n), F.lit(n - 1)), F.lit(0)).cast("int")


def _all_buckets(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("bucket"))


def bucket_histogram(df: DataFrame, n: int) -> DataFrame:
    """Count and percent per bucket, empty ones included, with the top bucket marked.

    Ties keep the lowest bucket. The pre-aggregated histogram has at most ``n`` rows; a bucket outside
    0..n-1, or none, is an error.
    """
    outside = F.raise_error(F.format_string(f"bucket %s is outside 0..{n - 1}", F.coalesce(F.col("bucket").cast("string"), F.lit("null")))).cast("int")
    held = F.when(F.col("bucket").between(0, n - 1), F.col("bucket")).otherwise(outside)
    counts = df.groupBy(held.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(F.lit(0))  # n <= 256 rows
    full = counts.join(F.broadcast(_all_buckets(df.sparkSession, n)), "bucket", "right")
    full = full.select("bucket", F.coalesce("c", F.lit(0)).alias("n"))
    total, best = F.sum("n").over(whole), F.max(F.struct("n", (-F.col("bucket")).alias("b"))).over(whole)
    return full.select(
        "bucket",
        "n",
        F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0).alias("pct"),
        (F.col("bucket") == -best["b"]).alias("is_top"),
    )


def bucket_histogram_per_file(df: DataFrame) -> DataFrame:
    """Histogram per file and in total in one aggregation; ``file_id`` is NULL in total rows."""
    sets = df.groupingSets([["file_id", "bucket"], ["bucket"]], "file_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    share = Window.partitionBy("file_id")  # rows here are (file, bucket) groups
    return sets.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(share))


def _rank_stats(hist: DataFrame, by: list[str], value: str, count: str) -> DataFrame:
    """Nearest-rank statistics from a histogram: the first value whose running count reaches ceil(p n)."""
    group = Window.partitionBy(*(by or [F.lit(0)]))
    run = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumns({"_run": F.sum(count).over(run), "_n": F.sum(count).over(group)})

    def rank(p: float) -> Column:
        return F.min(F.when(F.col("_run") >= F.ceil(F.lit(p) * F.col("_n")), F.col(value)))

    return h.groupBy(*by).agg(
        F.max("_n").alias("n"),
        (F.sum(F.col(value) * F.col(count)) / F.max("_n")).alias("mean"),
        rank(0.50).alias("p50"),
        rank(0.90).alias("p90"),
        rank(0.99).alias("p99"),
        F.max(value).alias("max"),
    )


def count_histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def active_count_stats(df: DataFrame, value: str) -> DataFrame:
    """``n, mean, p50, p90, p99, max`` of a bounded count; rows meet only as a histogram."""
    return _rank_stats(count_histogram(df, value), [], "value", "n")


#: Superbatches whose statistics one task works out.
SNAPSHOT_BLOCK = 64


def _snapshot_rows(rows: pa.Table) -> pa.Table:
    """Statistics of one block's superbatches: ``before`` rows (null superbatch) are in every one of them.

    One count per distinct value is held and goes on from superbatch to superbatch.
    """
    distinct = pc.unique(rows["value"])
    distinct = distinct.take(pc.array_sort_indices(distinct))
    place = pc.index_in(rows["value"], distinct).to_numpy(zero_copy_only=False)
    amount = rows["value"].cast(pa.float64()).to_numpy()
    n = rows["n"].to_numpy()
    steps = rows["superbatch"].combine_chunks()
    old = pc.is_null(steps).to_numpy(zero_copy_only=False)
    held = np.bincount(place[old], n[old], len(distinct)).astype(np.int64)
    total, weight = int(n[old].sum()), float((amount[old] * n[old]).sum())
    labels = pc.unique(steps.drop_null())
    labels = labels.take(pc.array_sort_indices(labels))
    which = pc.fill_null(pc.index_in(steps, labels), -1).to_numpy(zero_copy_only=False)
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(labels) + 1))
    counts, means, picks = [], [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        new = order[a:b]
        np.add.at(held, place[new], n[new])
        total, weight = total + int(n[new].sum()), weight + float((amount[new] * n[new]).sum())
        ranks = [-(-total * p // 100) for p in (50, 90, 99, 100)]  # nearest rank: ceil(p n)
        picks.append(np.searchsorted(np.cumsum(held), ranks))
        counts.append(total)
        means.append(weight / total)
    chosen = np.array(picks, np.int64).reshape(-1, 4)
    found = [distinct.take(pa.array(chosen[:, k])) for k in range(4)]
    return pa.Table.from_arrays([labels, pa.array(counts, pa.int64()), pa.array(means, pa.float64()), *found], names=["superbatch", "n", "mean", "p50", "p90", "p99", "max"])


def cumulative_snapshots(df: DataFrame, superbatch: str, value: str, block: int = SNAPSHOT_BLOCK) -> DataFrame:
    """The same statistics after each superbatch, over everything seen so far; null values and superbatches are left out.

    The corpus is reduced to a (superbatch, value) histogram first. Superbatches are cut into blocks of
    ``block`` in order; histograms add up, so a block gets the sum of all earlier ones as one row per value
    and works its superbatches out one after the other. A task holds its block's rows and a count per distinct
    value; no row is made per superbatch and value seen by then.
    """
    rows = df.select(F.col(superbatch).alias("superbatch"), F.col(value).alias("value")).where("superbatch is not null and value is not null")
    hist = rows.groupBy("superbatch", "value").agg(F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(Window.orderBy("superbatch")) - 1  # one row per superbatch
    blocks = hist.select("superbatch").distinct().withColumn("_block", F.floor(number / F.lit(block)).cast("int"))
    hist = materialise(hist.join(blocks, "superbatch"), "snapshots")
    last = hist.agg(F.max("_block")).first()[0] or 0
    summed = hist.groupBy("_block", "value").agg(F.sum("n").alias("n"))
    before = summed.where(F.col("_block") < last).withColumn("_block", F.explode(F.sequence(F.col("_block") + 1, F.lit(last))))
    before = before.groupBy("_block", "value").agg(F.sum("n").alias("n"))
    both = hist.unionByName(before.withColumn("superbatch", F.lit(None).cast(hist.schema["superbatch"].dataType)))
    types = dict(hist.dtypes)
    out = ", ".join([f"superbatch {types['superbatch']}", "n bigint", "mean double", *[f"{c} {types['value']}" for c in ("p50", "p90", "p99", "max")]])
    return both.groupBy("_block").applyInArrow(_snapshot_rows, out)
