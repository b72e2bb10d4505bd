"""Shuffled sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered, row_hash

ROUNDS = 6


def _digest(value: Column, seed: int, round_: Column) -> Column:
    """32 bits that depend on seed, round and value."""
    key = F.concat_ws(":", F.lit(str(seed)), round_.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def grid(n: int) -> tuple[int, int]:
    """(a, b) with a x b the smallest such product at or above ``n`` for a = ceil(sqrt n)."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(value: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the permutation of 0..a*b-1: halves modulo ``a`` and ``b`` are shifted in turn by
    a digest of the other half, which any fixed shift undoes."""
    state = F.struct(
        F.call_function("div", value, F.lit(b)).alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r")
    )

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        left, right = s["l"], s["r"]
        return F.struct(
            F.when(even, F.pmod(left + _digest(right, seed, i), F.lit(a))).otherwise(left).cast("long").alias("l"),
            F.when(even, right).otherwise(F.pmod(right + _digest(left, seed, i), F.lit(b))).cast("long").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permute(value: Column, n: int, seed: int) -> Column:
    """Permutation of 0..n-1. A place past the end walks on along its cycle until it is inside.

    Fewer than ceil(sqrt n) places lie past the end, so a walk ends within that many steps; only
    rows that start one pay for it.
    """
    a, b = grid(n)
    spare = a * b - n
    first = feistel(value, a, b, seed)
    if not spare:
        return first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(spare)), first, lambda p, _: F.when(p < F.lit(n), p).otherwise(feistel(p, a, b, seed))
    )
    return F.when(first < F.lit(n), first).otherwise(walk)


def shard(docs: DataFrame, shards: int, seed: int, key: str = "doc_id", shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Deal all rows into ``shards`` shards of counts at most one apart, in shuffled order.

    Rows are numbered by ``key`` (nulls first, then by the whole row); the permuted number p gives
    shard p mod ``shards`` and slot p div ``shards``, so either can be computed from the row number
    alone and a rerun, whatever the input splits, deals the same. Rows equal in every column are
    interchangeable. All columns are kept; an input column called like an output one is replaced.
    An empty table stays empty.
    """
    docs = docs.drop(shard_col, slot_col)
    place, tie = free_name(docs, "_place"), free_name(docs, "_tie")
    rows = docs.withColumn(tie, row_hash(docs))
    rows, manifest = numbered(rows, [F.col(f"`{key}`").asc_nulls_first(), F.col(tie), F.monotonically_increasing_id()], place, "shard")
    n = manifest.agg(F.sum("_n")).first()[0] or 0
    p = free_name(docs, "_permuted")
    rows = rows.withColumn(p, permute(F.col(place), max(n, 1), seed))
    return rows.withColumns(
        {
            shard_col: F.pmod(F.col(p), F.lit(shards)).cast("int"),
            slot_col: F.expr(f"`{p}` div {shards}").cast("long"),
        }
    ).drop(place, tie, p)
