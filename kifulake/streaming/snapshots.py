"""Incremental histograms and run summaries over arriving record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def active_histogram(stream: DataFrame, value: Column) -> DataFrame:
    """Cumulative histogram of a bounded count; the state has one row per bin."""
    return stream.groupBy(value.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def run_best_so_far(stream: DataFrame, run: str, superbatch: str, loss: str, positions: Column) -> DataFrame:
    """Best finite loss with its earliest superbatch and the totals of every run so far."""
    ok = ~F.isnan(loss) & (F.abs(loss) < F.lit(float("inf")))
    best = F.min(F.when(ok, F.struct(F.col(loss).alias("v"), F.col(superbatch).alias("sb"))))
    agg = stream.groupBy(F.col(run).alias("run")).agg(
        best.alias("_b"), F.sum(positions).alias("total_positions"), F.count(F.lit(1)).alias("n_superbatches")
    )
    return agg.select(
        "run", F.col("_b.v").alias("best_loss"), F.col("_b.sb").alias("best_loss_superbatch"),
        "total_positions", "n_superbatches",
    )


def run_to_snapshots(aggregate: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, writing the complete state after each batch as ``batch=<id>``.

    A batch that is run again after a failure replaces its own snapshot.
    """

    def publish(state: DataFrame, batch_id: int) -> None:
        state.write.mode("overwrite").parquet(f"{path}/batch={batch_id:08d}")

    query = (
        aggregate.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )
    query.awaitTermination()


def snapshots(aggregate: DataFrame, label: str) -> DataFrame:
    """Run a streaming aggregate over the available input; all snapshots with their ``batch``."""
    spark = aggregate.sparkSession
    path = scratch_path(spark, label)
    run_to_snapshots(aggregate, path, scratch_path(spark, f"{label}-checkpoint"))
    return spark.read.parquet(path)


def final_state(aggregate: DataFrame, label: str) -> DataFrame:
    """The state after the last batch."""
    every = snapshots(aggregate, label)
    last = every.agg(F.max("batch").alias("b")).first()["b"]
    return every.where(F.col("batch") == last).drop("batch")
