"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of the links (long columns u, v) with the smallest node it reaches.

    Each round ties every node's larger neighbours to its smallest one (large star), then its smaller
    neighbours and itself to the smallest (small star); a fixed point is a forest of stars. Rounds
    grow with the logarithm of the size. A hub's rows meet in joins alone, which Spark splits, and
    minima, which it forms before the shuffle. Each round is a table in the shared folder.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stash(edges, "links")
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = stash(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _state(edges)
        if now == state:
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        state = now
    raise RuntimeError("components did not settle")
