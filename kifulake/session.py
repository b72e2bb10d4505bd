"""Session construction and the shared scratch folder used by multi-stage jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kifulake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is designed around.

    ``master`` stays unset on a cluster, where spark-submit provides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "16384",
        "spark.ui.enabled": "false",
    }
    if not master:
        # on a cluster partitions start many and small, and AQE joins them up to its advisory size
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "8192"
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the cluster.

    Only a local master, whose executors share the driver's disk, gets a temporary folder instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


_SCOPE: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, or below the open :func:`scratch_scope`; never reused, so a retry
    cannot see old files."""
    return os.path.join(_SCOPE.get() or shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever Spark would write it; nothing happens if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession, label: str = "run") -> Iterator[str]:
    """One parent folder for all tables that jobs started inside write between their steps; deleted on leaving.

    Results are lazy: write or collect what was asked for before the block ends. A path for it that
    outlives the block is one taken from :func:`scratch_path` ahead of it. Blocks nest.
    """
    path = scratch_path(spark, label)
    before = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(before)
        delete_path(spark, path)


SPREAD_BYTES = 64 << 20


def input_bytes(df: DataFrame) -> int:
    """The planner's size estimate (file sizes, no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A tiny input dealt to all cores ahead of CPU-heavy work; anything larger as it is.

    A file of one row group cannot be split by the reader. Up to ``SPREAD_BYTES`` its rows are dealt out; beyond
    that the input's own splits stand.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if input_bytes(df) <= SPREAD_BYTES else df


#: Input of one task where a small row means much work: some 60,000 events.
TASK_BYTES = 1 << 20


def task_count(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for CPU-heavy work on small rows: as many as the input's size asks for, so that none grows with it."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // task_bytes))


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors. ``partition_by`` makes folders.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def keep_freed_memory() -> None:
    """Let a Python task use the memory of freed arrays again.

    As it starts, malloc maps every larger array anew and hands it back when freed, and paging it in takes as long as numpy's
    work on it. A block just under 32 MB, freed, raises both bounds (glibc; elsewhere nothing changes).
    """
    np.empty(31 << 20, np.uint8)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The same as passing it with ``--py-files``; needed where the driver alone has it on its path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "kifulake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
