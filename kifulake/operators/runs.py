"""Training-run histories and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """True for numbers that are neither NULL, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def recorded_history(df: DataFrame) -> DataFrame:
    """History as stored: a non-finite loss becomes 0.0, a non-finite test loss NULL."""
    return df.withColumns(
        {
            "recorded_loss": F.when(finite(F.col("loss")), F.col("loss")).otherwise(0.0),
            "test_loss": F.when(finite(F.col("test_loss")), F.col("test_loss")),
        }
    )


def run_best(df: DataFrame) -> DataFrame:
    """Best loss and best test loss per run with their superbatch; ties keep the earliest."""

    def best(col: str) -> Column:
        return F.min(F.when(finite(F.col(col)), F.struct(F.col(col).alias("v"), F.col("superbatch").alias("sb"))))

    agg = df.groupBy("run").agg(best("loss").alias("_l"), best("test_loss").alias("_t"))
    return agg.select(
        "run",
        F.col("_l.v").alias("best_loss"),
        F.col("_l.sb").alias("best_loss_superbatch"),
        F.col("_t.v").alias("best_test_loss"),
        F.col("_t.sb").alias("best_test_loss_superbatch"),
    )


def run_throughput(df: DataFrame, dataset_positions: int) -> DataFrame:
    """Positions, passes over the dataset and rounded positions per second; 0 without a base."""
    sums = df.groupBy("run").agg(F.sum("n_positions").alias("total_positions"), F.sum("seconds").alias("_s"))
    n, s = F.col("total_positions"), F.greatest(F.col("_s"), F.lit(0.0))
    passes = n / F.lit(float(dataset_positions)) if dataset_positions > 0 else F.lit(0.0)
    return sums.select(
        "run",
        "total_positions",
        F.round(s).cast("bigint").alias("training_time_seconds"),
        F.when(s > 0, F.round(n / s)).otherwise(0.0).cast("bigint").alias("mean_pos_per_sec"),
        passes.alias("dataset_passes"),
    )


def run_lineage(runs: DataFrame) -> DataFrame:
    """Resumed runs with the parent they continue: ``id, parent_id, checkpoint, superbatch``.

    A parent id that no run has stays NULL, as does everything taken from it.
    """
    child = runs.where(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("_pid"))
    parent = runs.select(
        F.col("id").alias("_pid"),
        F.col("id").alias("parent_id"),
        F.col("checkpoint").alias("resumed_from_checkpoint"),
        F.col("superbatch").alias("resumed_from_superbatch"),
    )
    return child.join(parent, "_pid", "left").drop("_pid")


def bench_summary(df: DataFrame, warmup: int) -> DataFrame:
    """Per case over its runs: mean, median, sample SD, min, max, CV%, after warm-up superbatches."""
    per_run = (
        df.where(F.col("superbatch") > warmup).groupBy("case_id", "run").agg(F.avg("pos_per_sec").alias("_m"))
    )
    out = per_run.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("_m").alias("mean"),
        F.median("_m").alias("median"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("_m")).otherwise(0.0).alias("sample_sd"),
        F.min("_m").alias("min"),
        F.max("_m").alias("max"),
    )
    return out.withColumn("cv_pct", F.when(F.col("mean") > 0, F.col("sample_sd") * 100.0 / F.col("mean")).otherwise(0.0))


def bench_paired_delta(df: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Candidate against baseline backend in the same (group, run): paired delta% and ratio of means."""

    def of(backend: str) -> Column:
        return F.avg(F.when(F.col("backend") == backend, F.col("pos_per_sec")))

    pairs = (
        df.where(F.col("backend").isin(baseline, candidate))
        .groupBy("grp", "run")
        .agg(of(baseline).alias("_a"), of(candidate).alias("_b"))
    )
    delta = (F.col("_b") / F.col("_a") - 1.0) * 100.0
    paired = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), delta)
    return pairs.groupBy("grp").agg(
        F.count(paired).alias("n_pairs"),
        F.avg(paired).alias("mean_delta_pct"),
        F.when(F.count(paired) > 1, F.stddev_samp(paired)).otherwise(0.0).alias("sd_delta_pct"),
        (F.avg("_b") / F.avg("_a")).alias("ratio"),
    )


def precision_speedup(df: DataFrame, slow: str, fast: str) -> DataFrame:
    """Ratio of mean throughput of two precisions per group."""
    mean = lambda p: F.avg(F.when(F.col("precision") == p, F.col("pos_per_sec")))
    return df.groupBy("grp").agg((mean(fast) / mean(slow)).alias("speedup"))


def bench_completeness(df: DataFrame, superbatches: int) -> DataFrame:
    """Problems per run: superbatches missing from 1..N, extra or repeated ones, bad values."""
    runs = df.select("run").distinct()
    wanted = runs.withColumn("superbatch", F.explode(F.sequence(F.lit(1), F.lit(superbatches))))
    actual = df.select("run", F.col("superbatch").cast("int").alias("superbatch"))
    missing = wanted.exceptAll(actual).groupBy("run").agg(F.count(F.lit(1)).alias("missing"))
    extra = actual.exceptAll(wanted).groupBy("run").agg(F.count(F.lit(1)).alias("extra"))
    value = F.col("pos_per_sec")
    bad = df.groupBy("run").agg(F.count_if(~(finite(value) & (value > 0))).alias("bad_values"))
    out = bad.join(missing, "run", "left").join(extra, "run", "left").fillna(0, ["missing", "extra"])
    ok = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("bad_values") == 0)
    return out.select("run", "missing", "extra", "bad_values", ok.alias("complete"))
