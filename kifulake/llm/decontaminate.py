"""Benchmark decontamination by winnowing: fingerprints are joined, hits extended word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Polynomial, mix, slices, stash, text_bytes, word_codes, word_spans

WINDOW = 13
GRAM = 5
#: Minimum of this many consecutive grams: any 13 equal words share a chosen gram.
SPREAD = WINDOW - GRAM + 1
REACH = WINDOW - GRAM
#: Item contexts of a gram up to which documents that hold it meet each of them.
FAN = 16
#: Bits of the filter: from 2^20, at least 16 per fingerprint, up to 2^27 (16 MB).
FILTER_BITS = (20, 27)
PROBES = (0, 18, 36)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
LETTERS = np.zeros(256, bool)
LETTERS[ord("0") : ord("9") + 1] = LETTERS[ord("a") : ord("z") + 1] = LETTERS[0x80:] = True

MARKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("fp", T.LongType()),
            T.StructField("n", T.IntegerType()),  # words of the gram
            T.StructField("whole", T.BooleanType()),  # a short item's only window
            T.StructField("at", T.IntegerType()),
            T.StructField("lead", T.IntegerType()),  # words of the context before the gram
            T.StructField("context", T.StringType()),
        ]
    )
)
MARK = pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("whole", pa.bool_()), ("at", pa.int32()), ("lead", pa.int32()), ("context", pa.string())])


def winnow(gram: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Places of the last smallest gram of each window of ``SPREAD`` grams that starts at a ``valid`` place."""
    starts = np.flatnonzero(valid)
    if not len(starts):
        return starts
    best, place = gram[starts], starts.copy()
    for d in range(1, SPREAD):
        nxt = gram[starts + d]
        lower = nxt <= best
        best = np.where(lower, nxt, best)
        place[lower] = starts[lower] + d
    return np.unique(place)


def _marks(batch: pa.RecordBatch, short: tuple[int, ...], allowed: np.ndarray | None, whole_items: bool):
    """(words per row, marks per row) of the column ``text``.

    ``short`` are the window lengths below ``WINDOW`` to look for. ``allowed`` is the filter's bit
    array, or None to keep every mark (items; ``whole_items`` then takes a short text as one gram).
    """
    raw, offsets = text_bytes(batch.column("text"))
    raw = FOLD[raw]
    start, end, first = word_spans(raw, offsets, LETTERS[raw])
    codes = Polynomial(word_codes(raw, start, end))
    n = len(start)
    last = np.repeat(first[1:], np.diff(first))  # end of the row of each word
    at = np.arange(n)
    grams = at[at + GRAM <= last]
    hashes = np.full(n, np.iinfo(np.uint64).max)
    hashes[grams] = codes.span(grams, grams + GRAM)
    chosen = winnow(hashes, at + WINDOW <= last)
    found = [(chosen, hashes[chosen], GRAM, False)]
    for m in short:
        places = at[at + m <= last]
        if whole_items:
            counts = np.diff(first)
            places = first[:-1][counts == m]
        found.append((places, mix(codes.span(places, places + m) ^ np.uint64(m)), m, True))
    marks: list[list] = [[] for _ in range(batch.num_rows)]
    text = raw.tobytes()
    for places, fps, m, whole in found:
        if allowed is not None and len(places):
            keep = _bits(allowed, fps)
            places, fps = places[keep], fps[keep]
        rows = np.searchsorted(first, places, "right") - 1
        for p, fp, r in zip(places.tolist(), fps.view(np.int64).tolist(), rows.tolist(), strict=True):
            lead = 0 if whole else min(REACH, p - int(first[r]))
            tail = m if whole else min(GRAM + REACH, int(first[r + 1]) - p)
            words = [text[start[i] : end[i]] for i in range(p - lead, p + tail)]
            marks[r].append({"fp": fp, "n": m, "whole": whole, "at": p - int(first[r]), "lead": lead, "context": b" ".join(words).decode("utf-8", "replace")})
    return np.diff(first), marks


def _bits(allowed: np.ndarray, fps: np.ndarray) -> np.ndarray:
    mask = np.uint64(64 * len(allowed) - 1)
    out = np.ones(len(fps), bool)
    for shift in PROBES:
        p = (fps >> np.uint64(shift)) & mask
        out &= (allowed[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def _scan(rows: DataFrame, short: tuple[int, ...], allowed=None, whole_items: bool = False) -> DataFrame:
    """Add ``n_words`` and ``marks`` to (keys, text) and drop the text."""
    keys = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*[rows.schema[c] for c in keys], T.StructField("n_words", T.LongType()), T.StructField("marks", MARKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if allowed is None else np.frombuffer(allowed.value, np.uint64)
        for whole in batches:
            for b in slices(whole, "text"):
                n, marks = _marks(b, short, bits, whole_items)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in keys], pa.array(n, pa.int64()), pa.array(marks, pa.list_(MARK))], [*keys, "n_words", "marks"]
                )

    return rows.mapInArrow(run, schema)


def _common_words(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _extend(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """From joined marks, the document words [begin, end) that equal the item's around the gram, where
    they make up a window."""
    schema = T.StructType(
        [*[pairs.schema[c] for c in keys], pairs.schema["context_id"], T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = {c: b.column(c).to_pylist() for c in ("n", "at", "lead", "context", "item_lead", "item_context", "whole")}
            take, begin, end = [], [], []
            for i, (n, at, lead, ours, item_lead, theirs, whole) in enumerate(zip(*d.values(), strict=True)):
                x, y = ours.split(" "), theirs.split(" ")
                if x[lead : lead + n] != y[item_lead : item_lead + n]:
                    continue  # equal hashes of unequal words
                left = _common_words(x[:lead][::-1], y[:item_lead][::-1])
                right = _common_words(x[lead + n :], y[item_lead + n :])
                if whole or left + n + right >= WINDOW:
                    take.append(i)
                    begin.append(at - left)
                    end.append(at + n + right)
            if take:
                idx = pa.array(take)
                cols = [b.column(c).take(idx) for c in (*keys, "context_id")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(begin, pa.int32()), pa.array(end, pa.int32())], schema.names)

    return pairs.mapInArrow(run, schema)


def _filter(fps: DataFrame) -> bytes:
    """Bit array over the distinct fingerprints of column ``fp``, sized by their number."""
    fps = fps.select("fp").distinct()
    least, most = FILTER_BITS
    size = min(most, max(least, (16 * fps.count()).bit_length()))
    place = F.explode(F.array(*[F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << size) - 1)) for s in PROBES]))
    words = (
        fps.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    )
    bits = np.zeros(1 << (size - 6), np.uint64)
    found = words.toArrow()  # at most 2^21 rows of two numbers, however many items
    bits[found["w"].to_numpy()] = found["v"].to_numpy().view(np.uint64)
    return bits.tobytes()


def _windows(marks: DataFrame, keys: list[str], lead: str, context: str) -> DataFrame:
    """(keys, window_id, begin): the windows of ``WINDOW`` words around each gram of ``marks`` within its context,
    by SHA-256 of their words; ``begin`` counts from the gram's place, down from 0."""
    words = F.split(context, " ")
    left = F.greatest(F.lit(0), F.col(lead) - REACH)
    last = F.least(F.col(lead), F.size(words) - WINDOW)
    starts = F.when(last >= left, F.sequence(left, last))
    rows = marks.withColumn("_start", F.explode(starts))
    return rows.select(
        *keys,
        F.sha2(F.array_join(F.slice(words, F.col("_start") + 1, F.lit(WINDOW)), " "), 256).alias("window_id"),
        (F.col("_start") - F.col(lead)).alias("begin"),
    )


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items, contaminated), a row per input row.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case. A window
    is 13 consecutive item words; a shorter item is one window. A document word in an occurrence of
    a window is hit; a document is contaminated if at least one word and 5% of its words are.

    The smallest of every 9 consecutive 5-gram hashes is kept on both sides, so 13 equal words share
    a kept gram; windows of shorter items are looked up as they are. A filter of the items'
    fingerprints, up to 2^27 bits, spares the join what cannot match; the join and the extension
    decide. Item contexts that repeat are one context, so common passages do not multiply documents
    by items before the list of items is asked for. A gram in over ``FAN`` different contexts (a
    common phrase) meets none of them: there both sides are extended to the windows of 13 words that
    hold it and joined on these, each distinct item window once, so a document meets no context
    that it does not share.

    Null text has no words. Rows equal in doc_id and text get the same result. Items without an id
    hit words but cannot be listed. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = stash(_scan(items, tuple(range(1, WINDOW)), whole_items=True), "items")
    marks = items.select("item_id", F.explode("marks").alias("m")).select(
        "item_id", "m.whole", "m.fp", "m.n", F.col("m.lead").alias("item_lead"), F.col("m.context").alias("item_context")
    )
    marks = marks.withColumn("context_id", F.sha2(F.concat_ws("|", "whole", "n", "item_lead", "item_context"), 256))
    marks = stash(marks, "item-marks")
    contexts = stash(marks.drop("item_id").distinct(), "contexts")
    gram = ["fp", "n", "whole"]
    common = stash(contexts.where("not whole").groupBy(*gram).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FAN).select(*gram), "common-grams")
    spelled = _windows(marks.join(common, gram, "left_semi"), ["item_id"], "item_lead", "item_context").select("item_id", "window_id").distinct()
    spelled = stash(spelled, "item-windows")
    listed = marks.select("context_id", "item_id").union(spelled.select("window_id", "item_id")).where("item_id is not null").distinct()
    short = tuple(sorted(r[0] for r in marks.where("whole").select("n").distinct().collect()))  # at most 12
    allowed = spark.sparkContext.broadcast(_filter(contexts))

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    scanned = stash(_scan(rows, short, allowed), "document-marks")
    keys = ["doc_id", "text_hash"]
    ours = scanned.select(*keys, F.explode("marks").alias("m")).select(*keys, "m.*").distinct()
    pairs = ours.join(contexts.join(common, gram, "left_anti"), gram)
    windows = _windows(ours.join(common, gram, "left_semi"), [*keys, "at"], "lead", "context")
    windows = windows.join(spelled.select("window_id").distinct(), "window_id")
    windows = windows.select(*keys, F.col("window_id").alias("context_id"), (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("begin") + WINDOW).alias("end"))
    spans = stash(_extend(pairs, keys).union(windows), "hits")
    by_doc = Window.partitionBy(*keys).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    hit = (
        spans.select(*keys, "begin", "end")
        .groupBy(*keys, "begin")
        .agg(F.max("end").alias("end"))
        .withColumn("upto", F.coalesce(F.max("end").over(by_doc), F.lit(0)))
        .groupBy(*keys)
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "upto"))).alias("n_hit"))
    )
    occurring = spans.select(*keys, "context_id").distinct().join(listed, "context_id").select(*keys, "item_id").distinct()
    occurring = occurring.groupBy(*keys).agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    found = hit.join(occurring, [hit[k].eqNullSafe(occurring[k]) for k in keys], "left").select(
        hit["doc_id"].alias("_d"), hit["text_hash"].alias("_h"), "n_hit", "items"
    )
    out = scanned.drop("marks").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        *keys,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )
