"""URL filters by Bloom filter cascades: exact membership of every key of the corpus, without a join.

Level 0 encodes the listed keys. What else of the corpus's keys passes it goes into level 1, the
listed keys that pass level 1 go into level 2, and so on until nothing passes by mistake. A key is
settled by the first level that does not hold it. Level 0 is made wide enough that no more keys pass
it by mistake than are listed, so the levels grow with the list, not with the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

BITS_PER_KEY = 12
HASHES = 4
MAX_BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The host or parents of it that have one of these numbers of labels, longest first.

    Only keys of as many labels as some listed one has are worth looking up, so a host of any number of labels
    costs its length per entry of ``counts``.
    """
    fit = [F.when(label_count(host) >= n, F.substring_index(host, ".", -n)) for n in sorted(set(counts), reverse=True)]
    return F.array_compact(F.array(*fit)) if fit else F.array().cast("array<string>")


def rule_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every key ``host suffix + path prefix`` that a rule for this URL could have, longest first.

    ``shapes`` are the (labels, path length) of the rules. A path starts with ``/`` or is empty
    and a host has no ``/``, so the joined key is unambiguous.
    """
    fit = [
        F.when((label_count(host) >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m)))
        for n, m in sorted(set(shapes))
    ]
    if not fit:
        return F.array().cast("array<string>")
    keys = F.transform(F.array_compact(F.array(*fit)), lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))
    return F.transform(F.sort_array(keys, asc=False), lambda s: s["k"])


@dataclass(frozen=True)
class Cascade:
    """The levels of a cascade: (bits, words of 64 bits)."""

    levels: tuple[tuple[int, tuple[int, ...]], ...]

    def has(self, key: Column) -> Column:
        """Whether ``key``, one of the universe's keys, is listed."""
        out = F.when(F.lit(False), F.lit(False))
        for i, (bits, words) in enumerate(self.levels):
            out = out.when(~_holds(key, i, bits, words), F.lit(i % 2 == 1))
        return out.otherwise(F.lit(len(self.levels) % 2 == 1))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """Double hashing inside 31 bits, so that sums never overflow."""
    low = F.lit(0x7FFFFFFF).cast("long")
    a, b = F.xxhash64(key, F.lit(2 * level)).bitwiseAND(low), F.xxhash64(key, F.lit(2 * level + 1)).bitwiseAND(low)
    return [F.pmod(a + F.lit(i) * b, F.lit(bits).cast("long")) for i in range(HASHES)]


def _holds(key: Column, level: int, bits: int, words: tuple[int, ...]) -> Column:
    # a literal of longs, folded once when the query is planned
    array = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    bit = lambda p: F.getbit(F.get(array, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    out = F.lit(True)
    for p in _places(key, level, bits):
        out = out & bit(p)
    return out


def _level(keys: DataFrame, level: int, per_key: int = BITS_PER_KEY) -> tuple[int, tuple[int, ...]] | None:
    """Bloom filter of the distinct column ``key``, as wide as its keys need; None for no keys.

    ``per_key`` bits a key are given up to the bound, ``BITS_PER_KEY`` or an error.
    """
    n = keys.count()
    if not n:
        return None
    bits = -(-n * BITS_PER_KEY // 64) * 64
    if bits > MAX_BITS:
        raise ValueError(f"{n} keys need {bits} bits at level {level}, over the bound of {MAX_BITS}")
    bits = min(MAX_BITS, -(-n * per_key // 64) * 64)
    words = (
        keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    )
    out = [0] * (bits // 64)
    for w, v in words.collect():  # at most MAX_BITS / 64 rows
        out[w] = v
    return bits, tuple(out)


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 40) -> Cascade:
    """The cascade of column ``key`` of ``listed`` that is exact for every ``key`` of ``universe``.

    ``universe`` may repeat keys: only those that pass level 0 by mistake are made distinct.
    The filters are literals of the plan, so their size is bounded: a level over ``MAX_BITS`` is
    refused. Null keys are not listed. An empty list gives a cascade that holds nothing.
    """
    listed = stash(listed.select("key").where("key is not null").distinct(), "listed")
    levels: list[tuple[int, tuple[int, ...]]] = []
    first = _level(listed, 0)
    if first is None:
        return Cascade(())

    def mistaken(level: tuple[int, tuple[int, ...]]) -> DataFrame:
        passed = universe.select("key").where("key is not null").where(_holds(F.col("key"), 0, *level)).distinct()
        return stash(passed.join(listed, "key", "left_anti"), "passed")

    other = mistaken(first)
    n, wrong = listed.count(), other.count()
    while wrong > n and first[0] < MAX_BITS:  # mistakes fall with the power HASHES of the width
        first = _level(listed, 0, math.ceil(first[0] / n * max(2.0, (wrong / n) ** (1 / HASHES))))
        other = mistaken(first)
        wrong = other.count()
    levels.append(first)
    inside = listed
    while len(levels) < max_levels:
        bits = _level(other, len(levels))
        if bits is None:
            return Cascade(tuple(levels))
        inside, other = other, stash(inside.where(_holds(F.col("key"), len(levels), *bits)), "passed")
        levels.append(bits)
    raise RuntimeError("the cascade did not close")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to rows with a ``url``.

    ``rules`` are (verdict, host, path): they fit the host and its subdomains where the path starts
    with theirs, and the longest wins (of equal length, the one later in code point order).
    Without a rule the verdict is ``block`` if the host or a parent of it is a ``key`` of
    ``listed``, else ``allow``. Input columns of those four names are replaced, others stay.
    A null url, or one without ``://``, has empty parts, no rule and is allowed. A host may have any
    number of labels: it is looked up at the label counts of the rules and of ``listed`` alone.
    """
    host, path = url_parts(F.col("url"))
    shapes = [(h.count(".") + 1, len(p)) for _, h, p in rules]
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    spark = pages.sparkSession
    every = rows.select(F.explode(rule_keys(F.col("host"), F.col("path"), shapes)).alias("key"))
    found = {}
    for verdict in sorted({v for v, _, _ in rules}):
        own = F.array(*[F.lit(h + p) for v, h, p in rules if v == verdict])
        keys = spark.range(1).select(F.explode(own).alias("key"))  # literals: no row comes from Python
        cascade = build_cascade(keys, every)
        found[verdict] = F.filter(rule_keys(F.col("host"), F.col("path"), shapes), cascade.has)
    listed = stash(listed.select("key").where("key is not null").distinct(), "listed-hosts")
    # as many rows as listed hosts have different label counts
    counts = [r[0] for r in listed.select(label_count(F.col("key"))).distinct().collect()]
    suffixes = host_suffixes(F.col("host"), counts)
    hosts = build_cascade(listed, rows.select(F.explode(suffixes).alias("key")))
    best = [
        F.struct(F.length(F.get(k, F.lit(0))).alias("n"), F.get(k, F.lit(0)).alias("k"), F.lit(v).alias("v")) for v, k in found.items()
    ]
    if best:
        longest = F.try_element_at(F.sort_array(F.filter(F.array(*best), lambda s: s["k"].isNotNull()), asc=False), F.lit(1))
        rows = rows.withColumns({"rule": longest["k"], "verdict": longest["v"]})
    else:
        rows = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    by_list = F.when(F.exists(suffixes, hosts.has), "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce("verdict", by_list))
