"""Computed columns the optimiser must not substitute into their uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add (or replace) ``name``, evaluated once per row.

    A plain projection may be inlined: into a filter pushed below it, or into a lambda that
    mentions it once but runs it once per element. A one-element ``explode`` keeps the row
    count, stays in whole-stage codegen and is never substituted.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))
