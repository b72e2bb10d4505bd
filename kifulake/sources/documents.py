"""Run documents, training logs and weight checkpoints."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import filesystem, qualified

# The training parameters of a run document, in its order.
PARAMS = """
  architecture: string, feature_set: string, ft_in: bigint, ft_factorize: boolean, l0: bigint, l1: bigint, l2: bigint,
  num_buckets: bigint, optimizer: string, bucket_mode: string, activation: string, progress_coeff: string,
  lr: double, lr_gamma: double, lr_step: bigint, lr_schedule: string, batch_size: bigint,
  batches_per_superbatch: bigint, superbatches: bigint, start_superbatch: bigint, wdl: double, start_wdl: double,
  end_wdl: double, scale: double, weight_decay: double, ft_weight_decay: double, dense_weight_decay: double,
  bias_weight_decay: double, ft_lr_mult: double, dense_lr_mult: double, bias_lr_mult: double,
  norm_loss_factor: double, qa: int, qb: int, loss_kind: string, wrm_in_scaling: double, wrm_in_offset: double,
  wrm_nnue2score: double, wrm_target_offset: double, wrm_target_scaling: double, wrm_pow_exp: double,
  wrm_qp_asymmetry: double, wrm_weight_boost_w1: double, wrm_weight_boost_w2: double, score_drop_abs: int,
  score_clamp_abs: int, prune_bands: string, prune_beta: double, prune_seed: decimal(20,0), init_from: string,
  init_preset: string, test_data: string, test_positions: bigint, test_tail_positions: bigint, tf32: boolean,
  ft_fp16: boolean, ft_fp16_out: boolean, fp16_opt_state: boolean, threads: bigint"""

# The run document. Absent keys read as NULL; nothing is inferred.
RUN_SCHEMA = f"""
  schema_version int, generator struct<name: string, version: string>, id string, name string,
  date string, status string, last_updated_at string, commit string, command string,
  lineage struct<parent_id: string, resumed_from_checkpoint: string, resumed_from_superbatch: bigint>,
  params struct<{PARAMS}>,
  data struct<name: string, positions: bigint, total_positions: bigint, dataset_passes: double>,
  results struct<training_time_seconds: bigint, fv_scale: int, best_loss: double, best_loss_superbatch: bigint,
    best_test_loss: double, best_test_loss_superbatch: bigint, mean_pos_per_sec: bigint, interrupted: boolean>,
  history array<struct<superbatch: bigint, loss: double, test_loss: double, test_accuracy: double>>,
  checkpoints array<string>
"""


def read_run_documents(spark: SparkSession, path: str, multi_line: bool = True, params: str | None = None) -> DataFrame:
    """Run documents under a declared schema; ``params`` replaces its parameter struct."""
    schema = RUN_SCHEMA
    if params:
        schema = schema.replace(f"params struct<{PARAMS}>", f"params struct<{params}>")
    docs = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return docs.withColumns({"started_at": F.try_to_timestamp("date"), "updated_at": F.try_to_timestamp("last_updated_at")})


def run_history(docs: DataFrame) -> DataFrame:
    """One row per run and superbatch."""
    return docs.select("id", F.explode("history").alias("h")).select("id", "h.*")


def _versions(spark: SparkSession, base: str) -> list[str]:
    """Complete version folders, oldest first: those whose write left a success marker."""
    fs, inner = filesystem(qualified(spark, base))
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("v"))
    marks = fs.get_file_info([f"{inner}/{n}/_SUCCESS" for n in names]) if names else []
    return [n for n, m in zip(names, marks) if m.type == pafs.FileType.File]


def write_version(rows: DataFrame, base: str, format: str) -> str:
    """Write a new version beside the earlier ones; readers switch when it is complete.

    ``base`` is listed where Spark writes: a path without a scheme lies in the default file system.
    """
    fs, inner = filesystem(qualified(rows.sparkSession, base))
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    taken = [int(f.base_name[1:]) for f in found if f.base_name[:1] == "v" and f.base_name[1:].isdigit()]
    path = f"{base}/v{max(taken, default=0) + 1:010d}"
    rows.write.format(format).save(path)
    return path


def write_snapshot(docs: DataFrame, base: str) -> str:
    """Write documents as a new snapshot below ``base``."""
    return write_version(docs, base, "json")


def latest_snapshot(base: str, spark: SparkSession | None = None) -> str:
    """The newest complete version; one that is still being written is not seen."""
    names = _versions(spark or SparkSession.active(), base)
    if not names:
        raise FileNotFoundError(f"no complete snapshot below {base}")
    return f"{base}/{names[-1]}"


_SUPERBATCH = r"^\[train\] superbatch\s+(\d+)/"
_THROUGHPUT = r"\s(\S+)\s+pos/s(?:\s|$)"


def parse_train_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """``superbatch, pos_per_sec`` of every throughput line; carriage returns also end lines.

    Other columns are kept. Lines that do not parse are left out.
    """
    keep = [c for c in lines.columns if c != column]
    rows = lines.select(*keep, F.explode(F.split(column, r"\r")).alias("_line"))
    rows = rows.select(
        *keep,
        F.regexp_extract("_line", _SUPERBATCH, 1).try_cast("int").alias("superbatch"),
        F.regexp_extract("_line", _THROUGHPUT, 1).try_cast("double").alias("pos_per_sec"),
    )
    return rows.where(F.col("superbatch").isNotNull() & F.col("pos_per_sec").isNotNull())


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """The parsed lines of one or more logs; logs without any such line are an error."""
    rows = parse_train_log(spark.read.option("lineSep", "\n").text(path))
    if rows.isEmpty():  # stops at the first line that parses
        raise ValueError(f"no throughput line in {path}")
    return rows


def write_epoch_weights(weights: DataFrame, path: str, epoch: int) -> None:
    """Store one epoch's weights; writing an epoch again replaces it and touches no other."""
    weights.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("epoch").parquet(path)


def final_weights(spark: SparkSession, path: str) -> DataFrame:
    """The weights of the last epoch stored: the highest epoch folder, found by listing."""
    fs, inner = filesystem(qualified(spark, path))
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.Directory]
    epochs = [int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=") and n[6:].isdigit()]
    if not epochs:
        raise FileNotFoundError(f"no epoch below {path}")
    return spark.read.parquet(f"{path}/epoch={max(epochs)}")
