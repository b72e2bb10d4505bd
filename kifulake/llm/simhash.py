"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, slices, stash, text_bytes, word_spans
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: (lowest bit, bits) of three blocks of a fingerprint.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Buckets up to this size compare their pairs; members of larger ones go through whole balls.
BUCKET = 32

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: For each byte, its eight bits in the eight bytes of a 64-bit lane counter.
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def _shingle_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle of every row, shingles per row)."""
    start, end, first = word_spans(raw, offsets, ~WHITE[raw])
    n = len(start)
    lengths = end - start
    # words with one space after each, rows one after another
    joined = np.full(int(lengths.sum()) + n, 0x20, np.uint8)
    begin = np.cumsum(lengths + 1) - lengths - 1
    word_of = np.repeat(np.arange(n), lengths)
    joined[np.arange(len(word_of)) + word_of] = raw[~WHITE[raw]]
    finish = begin + lengths
    words = np.diff(first)
    shingles = np.where(words == 0, 0, np.maximum(words - SHINGLE + 1, 1))
    at = np.arange(n)
    last = np.repeat(first[1:], words)
    head = at[(at + SHINGLE <= last) | (at == np.repeat(first[:-1], words))]
    tail = np.minimum(head + SHINGLE, last[head]) - 1 if n else head
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin[head].tolist(), finish[tail].tolist(), strict=True)), np.uint64, len(head))
    return hashes, shingles


def _majority(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of each row: bits set in over half of its hashes. Counts go in eight 8-bit lanes
    over runs of at most 255 hashes."""
    rows = len(shingles)
    counts = np.zeros((rows, 64), np.int64)
    if len(hashes):
        ends = np.cumsum(shingles)
        begins = ends - shingles
        pieces = -(-shingles // 255)
        row = np.repeat(np.arange(rows), pieces)
        within = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, begins[row] + 255 * within, axis=0)
        np.add.at(counts, row, sums.view(np.uint8).reshape(len(row), 64))
    set_ = (2 * counts > shingles[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) per row of whole texts; a text without words has fingerprint 0."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "text_hash", "fp")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                raw, offsets = text_bytes(b.column("text"))
                fp = _majority(*_shingle_hashes(_FOLD[raw], offsets))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp.view(np.int64))], schema.names)

    return rows.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: list[int], up_to: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(up_to + 1) for c in combinations(bits, n)]


def _variants(fp: Column, table: list[tuple[int, list[int]]]) -> Column:
    """(fp and a) xor b for every (a, bs) and b of bs; the bs are literals that the planner folds once."""
    parts = []
    for a, bs in table:
        flips = F.split(F.lit(",".join(str(_signed(b)) for b in bs)), ",").cast("array<bigint>")
        rest = fp.bitwiseAND(F.lit(_signed(a)).cast("long"))
        parts.append(F.transform(flips, rest.bitwiseXOR))
    return F.concat(*parts)


def pair_variants() -> list[tuple[int, list[int]]]:
    """For each pair of blocks, the pair's bits with at most one flipped; the third block's place says which pair.

    Of four differing bits, some pair of three blocks holds at most two (the third block holds at
    least two, or nothing differs by more than one anywhere), and two fingerprints within two bits
    on a pair share a variant within one bit of both.
    """
    out = []
    for i, (low, width) in enumerate(BLOCKS):
        hole = ((1 << width) - 1) << low
        kept = [b for b in range(64) if not hole >> b & 1]
        out.append((~hole & (1 << 64) - 1, [flip | (i + 1) << low for flip in _flips(kept, RADIUS // 4)]))
    return out


def ball_variants() -> list[tuple[int, list[int]]]:
    """Every fingerprint within half the radius."""
    return [((1 << 64) - 1, _flips(list(range(64)), RADIUS // 2))]


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links between the distinct fingerprints of column ``fp`` that join up all within ``RADIUS`` bits.

    Every fingerprint emits the variants within half the distance to be found and meets its
    neighbours in the variants' buckets. Whole balls (2,081 variants) would need 2,081 rows each, so
    the search is narrowed first: see :func:`pair_variants`, 132 rows each; buckets of up to
    ``BUCKET`` members verify their pairs. What lies in a larger bucket goes through whole balls:
    two members of a ball of half the radius are always linked, and a ball holds at most 2,081
    fingerprints, so one chain per bucket is enough and no pairs are made, however dense a group is.
    """
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.select("fp").repartition(tasks, "fp").select("fp", F.explode(_variants(F.col("fp"), pair_variants())).alias("key"))
    # fingerprints are distinct, so a bucket's rows are bounded by its free block, and move once
    members = spread.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    members = stash(members, "members")
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= RADIUS
    few = members.where(F.col("n") <= BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = F.flatten(
        F.transform(
            "fps",
            lambda a: F.transform(F.filter("fps", lambda b: (b > a) & close(a, b)), lambda b: F.struct(a.alias("u"), b.alias("v"))),
        )
    )
    some = few.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    dense = members.where(F.col("n") > BUCKET).select("fp").distinct()
    balls = dense.select("fp", F.explode(_variants(F.col("fp"), ball_variants())).alias("key"))
    balls = balls.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    chain = F.transform(F.slice("fps", F.lit(2), F.size("fps")), lambda x: F.struct(x.alias("u"), F.get("fps", F.lit(0)).alias("v")))
    many = balls.select(F.explode(chain).alias("p")).select("p.*").distinct()
    return some.union(many)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row: ``component_id`` is the smallest doc_id
    reachable over links of near fingerprints, ``root`` tells components apart.

    Equal fingerprints are one node, so copies are never paired. Texts without words share
    fingerprint 0 and are linked like any other; null doc_ids count only where a component has no
    other. An empty table gives no rows.
    """
    prints = stash(fingerprints(docs), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(nodes.join(least, "root").select("fp", "root", "component_id"), "component-of")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, rows): the document of each component that stays, the one of smallest doc_id
    (null last), then smallest text hash, and how many rows say it."""
    members = near_duplicates(docs).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    members = members.select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "rows").alias("m"))
    return members.groupBy("root").agg(F.min("m").alias("m")).select("m.doc_id", "m.text_hash", "m.rows")
