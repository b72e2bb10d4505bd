"""Loads every query module and names the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import corpus, evaluation, features, positions, storage  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bucket_histogram"].run(spark, sf_dir)
