"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered, row_hash, stash, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> also ``target``: the share of the total each source is to give.

    Sources take the weights in turn in code point order, null last. A target stops at
    ``max_repeats`` times its source's size; the excess is shared again by weight until none is
    above. Each round is one aggregate: the level left by the sources at their cap can only rise, so
    the set of these grows until it stays. One row per source and no window over them, so there may be
    as many as there are sites.
    """
    sizes, _ = numbered(sizes, [F.col("source").asc_nulls_last()], "_turn", "mix-turns")
    w = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("_turn", F.lit(len(weights))) + 1).cast("int"))
    t = stash(sizes.select("source", "source_size", w.alias("w"), (F.lit(max_repeats).cast("long") * F.col("source_size")).alias("cap")), "mix-caps")
    whole = "decimal(38,0)"
    left = t.agg(F.sum(F.col("source_size").cast(whole))).first()[0] or 0
    total, open_, n = int(left), int(t.agg(F.sum("w")).first()[0] or 0), -1
    left = total
    while True:
        # exact in integers: cap * open <= left * w says that the level reaches this source's cap
        capped = F.col("cap").cast(whole) * F.lit(open_).cast("decimal(19,0)") <= F.lit(left).cast(whole) * F.col("w").cast("decimal(19,0)")
        now = t.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap").cast(whole))), F.sum(F.when(~capped, F.col("w")))).first()
        if now[0] == n or not now[2]:
            break
        n, left, open_ = now[0], total - int(now[1] or 0), int(now[2])
    level = F.lit(float(left)) * F.col("w") / F.lit(open_)
    return t.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(level).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's start in [0, 1) as a decimal of 9 places, from a digest of seed and name."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return (F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long"), F.lit(10**9)).cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(10,9)")


def mix(
    docs: DataFrame,
    seed: int,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    prefix: str = "_mix_",
    size: Column | None = None,
) -> DataFrame:
    """Add how often each document goes into the mix, as columns ``<prefix>size``, ``<prefix>source_size``,
    ``<prefix>target`` and ``<prefix>copies``.

    A document's expected copies are its source's target / size, the same for all documents of the
    source, so their prefix sum is place x expectation. Places follow size, then ``doc_id``: the
    steps of one grid fall evenly over all lengths, and what a source gives differs from its target
    by little more than its largest document. A copy is taken for every whole number that the
    interval (offset + expectation x place, offset + expectation x (place + 1)] crosses; products
    are exact decimals. Expectation is at most ``max_repeats``, so are the copies.

    ``size`` is the words of ``text`` unless given. Null text: size 0. A null source is a source of its own. Equal rows are interchangeable. An
    empty table or a total of 0 takes nothing but copies of size 0. All input columns are kept.
    """
    tie, place, size_col = (free_name(docs, x) for x in ("_tie", "_place", f"{prefix}size"))
    source_size, target, copies = (free_name(docs, f"{prefix}{x}") for x in ("source_size", "target", "copies"))
    group = free_name(docs, "_mix_group")
    rows = docs.withColumns({size_col: word_count(F.col("text")) if size is None else size, tie: row_hash(docs), group: F.col("source")})
    order = [F.col(group).asc_nulls_last(), F.col(size_col), F.col("doc_id"), F.col(tie), F.monotonically_increasing_id()]
    rows, _ = numbered(rows, order, place, "mix", [group])
    # sizes per source from the numbered table: narrow scan, partial sums, one row per source
    sizes = rows.groupBy(F.col(f"`{group}`").alias("source")).agg(F.sum(size_col).alias("source_size"))
    plan = stash(source_targets(stash(sizes, "mix-sizes"), weights, max_repeats), "mix-targets")
    name, each, start = (free_name(rows, x) for x in ("_s", "_each", "_start"))
    plan = plan.select(
        F.col("source").alias(name),
        F.col("source_size").alias(source_size),
        F.col("target").alias(target),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).cast("decimal(14,12)").alias(each),
        offset(F.col("source"), seed).alias(start),
    )
    rows = rows.join(plan, F.col(group).eqNullSafe(F.col(name)))
    at = lambda p: F.floor(F.col(start) + F.col(each) * p.cast("decimal(18,0)"))
    taken = (at(F.col(place) + 1) - at(F.col(place))).cast("int").alias(copies)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], size_col, source_size, target, taken)
