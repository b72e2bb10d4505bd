"""Registered queries: a Spark callable and, where SQL can say it, the DuckDB text."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import adapters


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query. ``views`` are adapter views put before ``sql`` as CTEs.

    ``sql`` is either a SELECT or further CTEs followed by one.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = Query(name, run, compose(views, sql) if sql else None)
        return fn

    return register


def compose(views: tuple[str, ...], body: str) -> str:
    ctes = adapters.ctes(views)
    body = body.strip()
    if not ctes:
        return body if body.upper().startswith("SELECT") else f"WITH {body}"
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {ctes}{glue}{body}"
