"""Versioned artefacts by name: which are there, which to keep, and removing the others."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import filesystem, qualified


def keep_latest_k(names: DataFrame, column: str, pattern: str, k: int) -> DataFrame:
    """The ``k`` highest-numbered names of each series, as ``(name, series, version)``.

    ``pattern`` has two groups: series and version. Versions compare as numbers; names that
    do not match are ignored. Spark keeps each task's top ``k`` per series before the shuffle
    (window group limit), so a series with most of the names does not meet in one sort.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    matched = names.where(F.col(column).rlike(pattern)).select(
        F.regexp_extract(column, pattern, 1).alias("series"),
        F.regexp_extract(column, pattern, 2).try_cast("bigint").alias("version"),
        F.col(column).alias("name"),
    )
    matched = matched.where("version IS NOT NULL")  # digits beyond 64 bits are no version
    newest = Window.partitionBy("series").orderBy(F.col("version").desc())
    ranked = matched.withColumn("_rank", F.row_number().over(newest))
    return ranked.where(F.col("_rank") <= k).select("name", "series", "version")


def list_versions(spark: SparkSession, base: str) -> DataFrame:
    """``(name, path)`` of the visible files and folders below ``base``; none if it does not exist.

    Listing is metadata, one entry per version; it is not descended into.
    """
    fs, inner = filesystem(qualified(spark, base))
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    visible = sorted(f.base_name for f in found if not f.base_name.startswith(("_", ".")))
    names = pa.table({"name": pa.array(visible, pa.string())})
    return spark.createDataFrame(names).withColumn("path", F.concat(F.lit(base.rstrip("/") + "/"), "name"))


def remove(names: DataFrame, base: str) -> int:
    """Delete the files and folders ``name`` below ``base`` in parallel; how many were asked for.

    One that is gone already is no error, so lost tasks and whole runs may be repeated.
    """
    root = qualified(names.sparkSession, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = filesystem(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    if fs.get_file_info(f"{inner}/{name}").type == pafs.FileType.Directory:
                        fs.delete_dir(f"{inner}/{name}")
                    else:
                        fs.delete_file(f"{inner}/{name}")
                except FileNotFoundError:
                    pass
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return names.select("name").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def prune(spark: SparkSession, base: str, pattern: str, k: int) -> int:
    """Keep the ``k`` newest versions of each series below ``base`` (:func:`keep_latest_k`) and delete its others.

    Names that are no version by ``pattern`` stay. Returns how many were deleted: 0 when run again.
    """
    there = list_versions(spark, base)
    kept = keep_latest_k(there, "name", pattern, k).select("name")
    versions = keep_latest_k(there, "name", pattern, (1 << 31) - 1).select("name")
    return remove(versions.join(kept, "name", "left_anti"), base)
