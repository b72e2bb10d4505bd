"""Shared pieces of the training-data operators: tables between jobs, row numbers, word spans.

A row's identity is its ``doc_id`` together with its text: rows that agree in both are the same
document said twice, and every operator gives them the same result unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - loads pa.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path

WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or ``path``) and read it back; the shuffles behind it are then dropped.

    Cuts lineage in a way that survives lost executors and keeps one job's disk from adding to the next.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(stashed: DataFrame) -> None:
    """Delete the folder of a stashed table that nothing still to be computed reads."""
    delete_path(stashed.sparkSession, stashed._stash_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant of it that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(df: DataFrame) -> Column:
    """64-bit hash over all columns, a tie-break among rows; maps, which have no order, are left out."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def hash_cut(df: DataFrame, h: Column, want: int) -> int | None:
    """A bound that at least ``want`` rows have ``h`` (64-bit hashes) at or below, and few more; None if ``df`` has fewer.

    Rows are counted by 12 bits of the hash at a time, so at most 4,096 counts come back per pass, until the bin
    that holds the bound has no more than ``want`` rows (or is one hash).
    """
    unsigned = h.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # orders as h does
    prefix, below, depth = 0, 0, 0
    while True:
        rows = df.where(F.shiftrightunsigned(unsigned, 64 - depth) == prefix) if depth else df
        depth = min(depth + 12, 64)
        bins = rows.groupBy(F.shiftrightunsigned(unsigned, 64 - depth).alias("b")).count().collect()
        for b, n in sorted((b & (1 << 64) - 1, n) for b, n in bins):
            if below + n >= want:
                prefix = b if b < 1 << 63 else b - (1 << 64)
                break
            below += n
        else:
            return None
        if n <= want or depth == 64:
            return ((b + 1) << (64 - depth)) - 1 - (1 << 63)


def numbered(df: DataFrame, order: list[Column], out: str, label: str, groups: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``out``: each row's place from 0 in ``order``; the manifest of its partitions).

    Rows are dealt into ranges and sorted inside them, so no task sees more than its range however
    the keys are skewed, provided ``order`` tells rows apart; equal rows may swap places, which no
    result can show. With ``groups`` (leading columns of ``order``) places restart in each group.
    What crosses ranges is one count per range and group. Without groups the manifest (its rows are in
    ``_n``) has a row per partition, which the scheduler bounds, so its join is broadcast; with
    groups it grows with their number, and the optimiser chooses. Helper columns take names that
    ``df`` has not, so every column of ``df`` stays as it is.
    """
    groups = groups or []
    at, part, p, first, before = (free_name(df, f"_{x}") for x in ("at", "part", "p", "first", "before"))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = stash(rows, label).withColumn(part, F.shiftrightunsigned(at, 33))
    keys = [F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(groups)]
    manifest = rows.groupBy(F.col(part).alias("_p"), *keys).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    by = ", ".join(f"_g{i}" for i in range(len(groups)))
    running = f"sum(_n) over ({'partition by ' + by if by else ''} order by _p rows between unbounded preceding and 1 preceding)"
    manifest = stash(manifest.withColumn("_before", F.expr(f"coalesce({running}, 0L)")), f"{label}-manifest")
    own = [free_name(df, f"_g{i}") for i in range(len(groups))]
    lookup = manifest.select(
        F.col("_p").alias(p), *[F.col(f"_g{i}").alias(g) for i, g in enumerate(own)], F.col("_first").alias(first), F.col("_before").alias(before)
    )
    on = F.col(part) == F.col(p)
    for g, mine in zip(groups, own, strict=True):
        on = on & F.col(f"`{g}`").eqNullSafe(F.col(mine))
    joined = rows.join(lookup if groups else F.broadcast(lookup), on)
    place = (F.col(before) + F.col(at) - F.col(first)).alias(out)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], place), manifest


# ---- words of a batch of texts, as numpy arrays -------------------------------------------------

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
BATCH_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes in ``column`` (a longer row stands alone)."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // limit if len(lengths) else lengths
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of the column in order, row offsets with one more entry than rows); null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of maximal runs of ``in_word`` that never cross a row, and
    the number of the first word of each row (one more entry than rows).

    ``in_word`` is a mask over ``raw``. Separators are ASCII, so UTF-8 bytes can be used as they are.
    """
    edge = np.zeros(len(raw) + 1, bool)
    edge[:-1] = in_word
    begins = edge[:-1].copy()
    begins[1:] &= ~edge[:-2]
    ends = edge[:-1] & ~edge[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[inner] |= edge[inner]
    ends[inner - 1] |= edge[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


INVERSE = pow(int(BASE), -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Polynomial:
    """Hashes of spans of a sequence of 64-bit codes: prefix sums of code x base^place, mod 2^64."""

    def __init__(self, codes: np.ndarray, base: int = int(BASE)):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(base, n), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of codes[start:end]; equal spans agree wherever they lie."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * BASE)


def word_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code per word, from its bytes alone. Worked in pieces, so memory stays with the piece."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + (1 << 20), "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        out[i:j] = Polynomial(BYTE_CODES[raw[lo:hi]]).span(start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def word_ids(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(id of each word, the distinct words in order of their ids), compared byte by byte."""
    lengths = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, start, 1)  # a word may begin where another ends, at a row's edge
    np.add.at(edge, end, -1)
    data = raw[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit codes per word: the halves of XXH3's 128 bits over its bytes, taken once per distinct word."""
    ids, words = word_ids(raw, start, end)
    both = b"".join(xxhash.xxh3_128_digest(w) for w in words.to_pylist())
    halves = np.frombuffer(both, ">u8").astype(np.uint64).reshape(-1, 2)
    return halves[ids, 0], halves[ids, 1]
