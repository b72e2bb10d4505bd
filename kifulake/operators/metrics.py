"""Accuracy and reporting aggregates over predictions and superbatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def sign_agreement(out: Column, wdl: Column) -> Column:
    """Share of decided rows whose prediction sign matches; draws do not count, NaN if none."""
    hit = F.when(wdl != 0.5, F.when((out > 0) == (wdl > 0.5), 1.0).otherwise(0.0))
    return F.coalesce(F.avg(hit), F.lit(NAN))


def holdout_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``mean_loss, accuracy, n_positions, n_counted`` from ``sq_err, out, wdl``."""
    return df.groupBy(*(by or [])).agg(
        F.avg("sq_err").alias("mean_loss"),
        sign_agreement(F.col("out"), F.col("wdl")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_positions"),
        F.count_if(F.col("wdl") != 0.5).alias("n_counted"),
    )


def superbatch_summary(df: DataFrame, last_superbatch: int, positions_per_superbatch: int) -> DataFrame:
    """Per superbatch: mean loss (NaN without positions), throughput and time left.

    ``df`` has ``superbatch_id, loss, seconds`` per position or per batch with ``n``.
    """
    sums = df.groupBy("superbatch_id").agg(
        F.sum("loss").alias("_loss"), F.sum("n").cast("bigint").alias("n_positions"), F.sum("seconds").alias("_sec")
    )
    n = F.col("n_positions")
    rate = n / F.greatest(F.col("_sec"), F.lit(1e-9))
    left = (F.lit(last_superbatch) - F.col("superbatch_id")) * F.lit(float(positions_per_superbatch))
    return sums.select(
        "superbatch_id",
        "n_positions",
        F.when(n > 0, F.col("_loss") / n).otherwise(F.lit(NAN)).alias("mean_loss"),
        rate.alias("pos_per_sec"),
        F.when(rate > 0, left / rate).otherwise(F.lit(NAN)).alias("eta_seconds"),
    )
