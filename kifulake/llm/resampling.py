"""Importance resampling of documents towards a target collection, by hashed word n-grams.

Every distinct feature of a batch is hashed once: the bytes of features of equal length form a
two-dimensional array of bytes, in which the CRC-32 of all of them advances one column at a time;
the buckets are then scattered back to the places where the features stand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, slices, stash, text_bytes, word_ids, word_spans
from .decontaminate import FOLD, LETTERS

BUCKETS = 10_000
#: Longer features are so few that a column for all of them holds next to nothing: these go one by one.
LONGEST_ROW = 2048
_CELLS = 8 << 20


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc_matrices(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32 of every byte string ``data[offsets[i]:offsets[i + 1]]``, by matrices of equal length."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        n = int(lengths[same[0]])
        if n > LONGEST_ROW:
            out[same] = [zlib.crc32(data[offsets[i] : offsets[i + 1]].tobytes()) for i in same]
            continue
        step = max(1, _CELLS // max(n, 1))
        for i in range(0, len(same), step):
            rows = same[i : i + step]
            # one matrix row per byte place, so that a place is contiguous for all features
            matrix = data[np.arange(n)[:, None] + offsets[rows]]
            crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = _CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[rows] = ~crc
    return out


def feature_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text with one more entry than texts, bucket of every word, bucket of every
    word with its successor: -1 for a text's last word)."""
    raw, offsets = text_bytes(texts)
    raw = FOLD[raw]
    start, end, first = word_spans(raw, offsets, LETTERS[raw])
    if not len(start):
        return first, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, words = word_ids(raw, start, end)
    single = crc_matrices(*text_bytes(words)).astype(np.int64) % buckets
    last = np.zeros(len(start), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    pair = np.flatnonzero(~last)
    which, distinct = pd.factorize(ids[pair] * len(words) + ids[pair + 1])
    double = np.full(len(start), -1, np.int64)
    if len(pair):
        left, right = pa.array(distinct // len(words)), pa.array(distinct % len(words))
        joined = pc.binary_join_element_wise(words.take(left), words.take(right), pa.scalar(b" ", pa.large_binary()))
        double[pair] = (crc_matrices(*text_bytes(joined)).astype(np.int64) % buckets)[which]
    return first, single[ids], double


def _text(df: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts per bucket. A task sends one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                _, single, double = feature_buckets(b.column("text"), buckets)
                total += np.bincount(single, minlength=buckets) + np.bincount(double[double >= 0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    return docs.select(_text(docs).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket: 1000 x log of its smoothed share in ``target`` over that in ``source``, floored.

    Both counts have a row per bucket, so what comes to the driver is bounded by ``buckets``.
    """
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(
        target.select("bucket", F.lit(0).cast("long"), "n")
    )
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()
    s, t = np.zeros(buckets), np.zeros(buckets)
    at = np.asarray(rows["bucket"], np.int64)
    s[at], t[at] = np.asarray(rows["s"]), np.asarray(rows["t"])
    ratio = (t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight) per row: the floored mean gain of its features."""
    keys = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), _text(docs).alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("text_hash", "n_words", "n_features", "weight")]
    schema = T.StructType([keys.schema["doc_id"], *longs])
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.append(gain, 0)  # place -1: no feature
        for whole in batches:
            for b in slices(whole, "text"):
                first, single, double = feature_buckets(b.column("text"), buckets)
                sums = np.concatenate(([0], np.cumsum(table[single] + table[double])))
                words = np.diff(first)
                n = np.maximum(2 * words - 1, 0)
                mean = (sums[first[1:]] - sums[first[:-1]]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text_hash"), pa.array(words), pa.array(n), pa.array(mean)], schema.names
                )

    return keys.mapInArrow(run, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 x a Gumbel draw of the document, floored, from a digest of seed and id (a null id has its own)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight, score, rank) per row of ``docs``.

    Draws ``percent`` of the rows with at least ``min_words`` words without replacement, with odds by
    how much likelier ``target`` makes a document's words and word pairs than ``docs`` does: the
    highest of weight plus Gumbel noise win, ties go to the smaller doc_id (null first). ``rank`` counts the
    drawn ones from 1 and is null for all others.

    Null and word-free texts have no features and weight 0. Every row is a document: repeated rows
    have the same score and ranks of their own. Empty tables give no rows; with an empty ``target``
    all buckets are smoothed alike. Other columns of ``docs`` and ``target`` are not looked at.

    Jobs: one over all texts for the bucket counts (a row per bucket and task), one for the weights,
    and a range sort of narrow rows for the ranks.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    rows = weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = stash(rows, "resample-scores")
    long_enough = rows.where(F.col("n_words") >= min_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    placed, manifest = numbered(long_enough, order, "place", "resample-ranks")
    drawn = (manifest.agg(F.sum("_n")).first()[0] or 0) * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    ranked = placed.select(*rows.columns, rank.cast("long").alias("rank"))
    return ranked.union(rows.where(F.col("n_words") < min_words).select(*rows.columns, F.lit(None).cast("long").alias("rank")))
