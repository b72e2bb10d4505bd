"""File access that works on a laptop folder and on a cluster's shared store alike."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

#: Hadoop's names of stores that have another one here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "wasb"}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` (a comma list) as Spark would resolve it: without a scheme it lies in the default file system."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if default.startswith("file:"):
        return path
    parts = (p.strip() for p in path.split(","))
    return ",".join(p if not p or "://" in p or p.startswith("file:") else default.rstrip("/") + "/" + p.lstrip("/") for p in parts)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path inside it."""
    if "://" in path or path.startswith("file:"):
        scheme, colon, rest = path.partition(":")
        path = SCHEMES.get(scheme, scheme) + colon + rest
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """``(path, size)`` of the data files named by ``path``: a comma list of files or folders.

    List order is kept; a folder contributes its visible files by name. This is metadata: one
    entry per file.
    """
    out: list[tuple[str, int]] = []
    for part in (p.strip() for p in path.split(",")):
        if not part:
            continue
        fs, inner = filesystem(part)
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(part)
        prefix = part[: len(part) - len(inner)] if part.endswith(inner) else ""
        if info.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(inner))
            visible = [f for f in found if f.is_file and not f.base_name.startswith(("_", "."))]
            out += [(prefix + f.path, f.size) for f in sorted(visible, key=lambda f: f.path)]
        else:
            out.append((prefix + info.path, info.size))
    return out
