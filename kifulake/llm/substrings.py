"""Exact removal of repeated 20-word spans, found by recompression.

Rounds name runs of equal words, then pairs of neighbours, by a hash of what they stand for. A name
so needs no dictionary and is the same in every task, and whether two neighbours pair depends on the
two alone, so equal stretches of text are cut alike wherever they lie, but for their edges. Each
symbol carries the words that had a say in it (its context): a window that holds a symbol's whole
context holds the same symbol in every other place. Every window elects one such symbol by its
content. An elected symbol found once in the corpus settles its windows as unrepeated; only
windows of symbols found again are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, WHITE, Polynomial, mix, numbered, slices, stash, text_bytes, word_hashes, word_spans

WINDOW = 20
ROUNDS = 4
_FAR = np.int64(1) << 40
_INDEX_BITS = 26
PIECE = 1 << 24  # words that are worked at a time
_SECOND = 0xD6E8FEB86659FD93  # base of the second window hash


def _coin(name: np.ndarray, round_: int) -> np.ndarray:
    return (mix(name ^ np.uint64(0x51ED270B * (round_ + 1))) >> np.uint64(17)) & np.uint64(1)


def recompress(codes: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, context start, context end) of the symbols after ``rounds`` rounds, in word places.

    ``first`` has the first word of each text (one more entry than texts). Where an edge of the text
    had a say, the context reaches far outside, so that no window holds it.
    """
    n = len(codes)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # runs: a maximal run of one word becomes one symbol; its length was decided by both neighbours
    same = np.zeros(n, bool)
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    begin = np.flatnonzero(~same)
    end = np.append(begin[1:], n)[: len(begin)]
    k = end - begin
    row = row[begin]
    name = np.where(k > 1, mix(codes[begin] * np.uint64(3) + k.astype(np.uint64)), codes[begin])
    lo = np.where(begin == first[row], -_FAR, begin - 1)
    hi = np.where(end == first[row + 1], _FAR, end + 1)
    for r in range(rounds):
        m = len(name)
        if m < 2:
            break
        c = _coin(name, r)
        beside = row[1:] == row[:-1]  # symbols i and i + 1 lie in one text
        pair = beside & (c[:-1] == 0) & (c[1:] == 1)
        leads, follows = np.append(pair, False), np.append(False, pair)
        new_lo, new_hi = lo.copy(), hi.copy()
        # an unpaired symbol was decided by the neighbour it could have paired with
        i = np.flatnonzero((c == 0) & ~leads)
        j = np.minimum(i + 1, m - 1)
        has = np.append(beside, False)[i]
        new_lo[i] = np.where(has, np.minimum(lo[i], lo[j]), lo[i])
        new_hi[i] = np.where(has, np.maximum(hi[i], hi[j]), _FAR)
        i = np.flatnonzero((c == 1) & ~follows)
        j = np.maximum(i - 1, 0)
        has = np.append(False, beside)[i]
        new_lo[i] = np.where(has, np.minimum(lo[i], lo[j]), -_FAR)
        new_hi[i] = np.where(has, np.maximum(hi[i], hi[j]), hi[i])
        i = np.flatnonzero(pair)
        name[i] = mix(name[i] * BASE + name[i + 1])
        new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
        stay = ~follows
        name, lo, hi, row = name[stay], new_lo[stay], new_hi[stay], row[stay]
    return name, lo, hi


def window_starts(first: np.ndarray) -> np.ndarray:
    """Whether a window starts at each word."""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + WINDOW <= last


def elect(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows): stretches of windows that elected the same symbol place.

    Of the symbols whose context it holds, a window elects that of smallest key (the leftmost of
    equals); the key is a hash of the name and the context's words. A window that holds none is a
    stretch of its own with the hash of its words.
    """
    n = len(codes)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    poly = Polynomial(codes)
    name, lo, hi = recompress(codes, first)
    good = hi - lo <= WINDOW
    name, lo, hi = name[good], lo[good], hi[good]
    key = mix(poly.span(lo, hi) ^ name)
    best = np.full(n, np.iinfo(np.uint64).max)
    packed = (key >> np.uint64(_INDEX_BITS) << np.uint64(_INDEX_BITS)) | np.arange(len(key), dtype=np.uint64)
    start = np.maximum(hi - WINDOW, 0)
    for d in range(WINDOW):
        at = start + d
        inside = at <= lo
        if not inside.any():
            break
        np.minimum.at(best, at[inside], packed[inside])
    starts = window_starts(first)
    place = np.flatnonzero(starts)
    mine = best[place]
    orphan = mine == np.iinfo(np.uint64).max
    which = np.where(orphan, -1 - place, (mine & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64))
    cut = np.ones(len(place), bool)
    cut[1:] = (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(cut)
    size = np.diff(np.append(head, len(place)))
    own = mix(poly.span(place, place + WINDOW) ^ np.uint64(0xA5A5A5A5))
    keys = np.where(orphan[head], own[head], key[np.maximum(which[head], 0)] if len(key) else own[head])
    return keys, place[head], size


def elect_in_pieces(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`elect`, ``PIECE`` windows at a time.

    What a window elects depends on its own words alone, so a piece only needs the words of its windows. A
    stretch that a cut runs through becomes two of one key, which are then compared like any found again.
    """
    parts = []
    for a in range(0, max(1, len(codes)), PIECE):
        z = min(len(codes), a + PIECE + WINDOW - 1)
        key, head, size = elect(codes[a:z], np.clip(first, a, z) - a)
        parts.append((key, head + a, size))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _words(texts: pa.Array):
    raw, offsets = text_bytes(texts)
    start, end, first = word_spans(raw, offsets, ~WHITE[raw])
    return raw, start, end, first


def _stretches(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, key, span): the elected stretches; span is first window x 32 + windows."""
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text_hash"], T.StructField("key", T.LongType()), T.StructField("span", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                raw, start, end, first = _words(b.column("text"))
                key, head, size = elect_in_pieces(word_hashes(raw, start, end)[0], first)
                at = np.searchsorted(first, head, "right") - 1
                span = (head - first[at]) * 32 + size
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), b.column("text_hash").take(take), pa.array(key.view(np.int64)), pa.array(span)], schema.names
                )

    return rows.mapInArrow(run, schema)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column; null is empty."""
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)))


def _open_windows(first: np.ndarray, spans: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Windows (a mask over words) that no unrepeated stretch holds."""
    n = int(first[-1])
    at = np.repeat(first[:-1], np.diff(upto)) + (spans >> 5)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + (spans & 31), -1)
    return window_starts(first) & (np.cumsum(change)[:n] == 0)


def _candidates(rows: DataFrame) -> DataFrame:
    """Adds n_words and the windows still open as (first, number) runs, packed in one long each."""
    keys = [c for c in rows.columns if c not in ("text", "spans")]
    schema = T.StructType(
        [*[rows.schema[c] for c in keys], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("open", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                _, _, _, first = _words(b.column("text"))
                free = _open_windows(first, *_lists(b.column("spans")))
                edge = np.diff(np.concatenate(([0], free.view(np.int8), [0])))
                edge_in = edge[:-1].copy()
                # runs end at text ends by themselves: the last words of a text start no window
                begin, end = np.flatnonzero(edge_in == 1), np.flatnonzero(edge == -1)
                at = np.searchsorted(first, begin, "right") - 1
                packed = (begin - first[at]) << 31 | (end - begin)
                upto = np.searchsorted(at, np.arange(len(first)), "left").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(packed))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in keys], b.column("text"), pa.array(np.diff(first)), lists], schema.names
                )

    return rows.mapInArrow(run, schema)


def _unpack_open(first: np.ndarray, packed: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The packed runs of each row as a mask over words."""
    change = np.zeros(int(first[-1]) + 1, np.int32)
    at = np.repeat(first[:-1], np.diff(upto)) + (packed >> 31)
    np.add.at(change, at, 1)
    np.add.at(change, at + (packed & ((1 << 31) - 1)), -1)
    return np.cumsum(change)[:-1] > 0


def _window_rows(rows: DataFrame, start_bits: int) -> DataFrame:
    """(k1, k2, place) of every open window: two hashes of its words, document number and start."""
    schema = "k1 long, k2 long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                raw, start, end, first = _words(b.column("text"))
                codes, others = word_hashes(raw, start, end)
                at = np.flatnonzero(_unpack_open(first, *_lists(b.column("open"))))
                row = np.searchsorted(first, at, "right") - 1
                doc = b.column("doc_no").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                k1 = Polynomial(codes).span(at, at + WINDOW)
                k2 = Polynomial(others, _SECOND).span(at, at + WINDOW)
                place = doc << start_bits | (at - first[row])
                for i in range(0, len(at), 1 << 18):
                    cut = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k1[cut].view(np.int64)), pa.array(k2[cut].view(np.int64)), pa.array(place[cut])], ["k1", "k2", "place"]
                    )

    return rows.mapInArrow(run, schema)


RANGE = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])


def _cut(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_removed, removed, kept) from open windows and first occurrences."""
    schema = T.StructType(
        [
            rows.schema["doc_id"], rows.schema["text_hash"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
            T.StructField("removed", T.ArrayType(RANGE)), T.StructField("kept", T.StringType()),
        ]
    )
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                raw, start, end, first = _words(b.column("text"))
                again = _unpack_open(first, *_lists(b.column("open")))
                values, upto = _lists(b.column("firsts"))
                again[np.repeat(first[:-1], np.diff(upto)) + values] = False
                at = np.flatnonzero(again)
                change = np.zeros(int(first[-1]) + 1, np.int32)
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
                gone = np.cumsum(change)[:-1] > 0
                text = raw.tobytes()
                lost = np.concatenate(([0], np.cumsum(gone)))
                removed, kept = [], []
                for i in range(b.num_rows):
                    a, z = int(first[i]), int(first[i + 1])
                    mine = gone[a:z]
                    edge = np.diff(np.concatenate(([0], mine.view(np.int8), [0])))
                    removed.append([{"begin": x, "end": y} for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                    stay = a + np.flatnonzero(~mine)
                    kept.append(b" ".join([text[x:y] for x, y in zip(start[stay].tolist(), end[stay].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("text_hash"), pa.array(np.diff(first)), pa.array(lost[first[1:]] - lost[first[:-1]]),
                        pa.array(removed, pa.list_(span)), pa.array(kept, pa.string()),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_removed, removed, kept) per row.

    A word is removed if a window of 20 words over it has the words of a window that starts earlier:
    in a document before it (smaller doc_id; null first; of equal ids by text hash), or earlier in
    the same one. All windows are judged on the input. ``removed`` holds word ranges, ``kept`` the
    kept words joined by one space.

    Jobs: (1) every text emits its elected stretches; keys are counted, and those found once go back
    to their document; (2) each document, given these, keeps the windows still open; (3) open windows
    are grouped by two 64-bit hashes of their words and the first place of each group goes back;
    (4) open windows that are nobody's first place are removed. Groups are only counted and
    minimised, before the shuffle where possible, so a passage in a third of all documents is no hot
    task. Texts move once for (2), and those with open windows once more for (4).

    Words are told apart by 128 bits over their bytes, however long they are. Texts are worked in pieces,
    so a row may have any number of words that a task can hold.

    Null and word-free texts keep nothing and lose nothing. Rows equal in doc_id and text are one
    document and get the same result.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce(text, F.lit("")).alias("text"))
    keys = ["doc_id", "text_hash"]
    found = _stretches(rows).groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in (*keys, "span")])
    single = stash(found.where("n = 1").select(*keys, "span"), "single-stretches")
    spans = single.groupBy(*keys).agg(F.collect_list("span").alias("spans"))
    numbers, manifest = numbered(rows.select(*keys).distinct(), [F.col("doc_id").asc_nulls_first(), F.col("text_hash")], "doc_no", "doc-numbers")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    known = numbers.join(spans, same(numbers, spans), "left").select(*[numbers[k] for k in keys], "doc_no", "spans")
    joined = rows.join(known, same(rows, known)).select(*[rows[k] for k in keys], "doc_no", "spans", "text")
    opened = stash(_candidates(joined), "open-windows")
    some = opened.where(F.size("open") > 0)

    longest, most = some.agg(F.max("n_words"), F.max("doc_no")).first()
    start_bits = max(1, int(longest or 0).bit_length())
    if start_bits + int(most or 0).bit_length() > 63:
        raise ValueError("documents and words do not fit one 64-bit place")
    firsts = _window_rows(some.select("doc_no", "text", "open"), start_bits).groupBy("k1", "k2").agg(F.min("place").alias("place"))
    firsts = firsts.select(F.shiftright("place", start_bits).alias("no"), F.col("place").bitwiseAND(F.lit((1 << start_bits) - 1)).alias("start"))
    firsts = stash(firsts.groupBy("no").agg(F.collect_list("start").alias("firsts")), "first-windows")
    changed = _cut(some.join(firsts, F.col("doc_no") == F.col("no"), "left").select(*keys, "text", "open", "firsts"))
    words = F.array_join(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ")
    rest = opened.where(F.size("open") == 0).select(
        *keys, "n_words", F.lit(0).cast("long").alias("n_removed"), F.array().cast(T.ArrayType(RANGE)).alias("removed"), words.alias("kept")
    )
    return changed.union(rest)
