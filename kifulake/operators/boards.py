"""Board rows: packed encodings, their decoders, text positions and piece rows.

A position row has ``board`` (81 codes, ``type * 2 + color``), ``black_hand`` and
``white_hand`` (seven counts), ``stm``, ``bk_sq`` and ``wk_sq``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - loads pa.compute
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import bind
from . import dims

RECORD_BITS = 256

# Fixed values: (code, bits) of the packed-position format, least significant bit first.
# On the board a promotion bit (except gold) and a color bit follow; in hand the first bit of
# the code is left out and a set promotion bit means "in the box".
PACKED_CODES = {
    0: (0x00, 1), dims.PAWN: (0x01, 2), dims.LANCE: (0x03, 4), dims.KNIGHT: (0x0B, 4),
    dims.SILVER: (0x07, 4), dims.BISHOP: (0x1F, 6), dims.ROOK: (0x3F, 6), dims.GOLD: (0x0F, 5),
}

# Fixed values: (pattern, bits) per (type, color) of the second format, on the board ...
HUFFMAN_BOARD = {
    (0, 0): (0b0, 1),
    (dims.PAWN, 0): (0b1, 4), (dims.LANCE, 0): (0b11, 6), (dims.KNIGHT, 0): (0b111, 6),
    (dims.SILVER, 0): (0b1011, 6), (dims.BISHOP, 0): (0b11111, 8), (dims.ROOK, 0): (0b111111, 8),
    (dims.GOLD, 0): (0b1111, 6), (dims.PRO_PAWN, 0): (0b1001, 4), (dims.PRO_LANCE, 0): (0b100011, 6),
    (dims.PRO_KNIGHT, 0): (0b100111, 6), (dims.PRO_SILVER, 0): (0b101011, 6),
    (dims.HORSE, 0): (0b10011111, 8), (dims.DRAGON, 0): (0b10111111, 8),
    (dims.PAWN, 1): (0b101, 4), (dims.LANCE, 1): (0b10011, 6), (dims.KNIGHT, 1): (0b10111, 6),
    (dims.SILVER, 1): (0b11011, 6), (dims.BISHOP, 1): (0b01011111, 8), (dims.ROOK, 1): (0b01111111, 8),
    (dims.GOLD, 1): (0b101111, 6), (dims.PRO_PAWN, 1): (0b1101, 4), (dims.PRO_LANCE, 1): (0b110011, 6),
    (dims.PRO_KNIGHT, 1): (0b110111, 6), (dims.PRO_SILVER, 1): (0b111011, 6),
    (dims.HORSE, 1): (0b11011111, 8), (dims.DRAGON, 1): (0b11111111, 8),
}
# ... and in hand.
HUFFMAN_HAND = {
    (dims.PAWN, 0): (0b0, 3), (dims.LANCE, 0): (0b1, 5), (dims.KNIGHT, 0): (0b11, 5),
    (dims.SILVER, 0): (0b101, 5), (dims.GOLD, 0): (0b111, 5), (dims.BISHOP, 0): (0b11111, 7),
    (dims.ROOK, 0): (0b111111, 7),
    (dims.PAWN, 1): (0b100, 3), (dims.LANCE, 1): (0b10001, 5), (dims.KNIGHT, 1): (0b10011, 5),
    (dims.SILVER, 1): (0b10101, 5), (dims.GOLD, 1): (0b10111, 5), (dims.BISHOP, 1): (0b1011111, 7),
    (dims.ROOK, 1): (0b1111111, 7),
}


def _text_bits(value: int, n: int) -> str:
    return "".join(str(value >> k & 1) for k in range(n))


def packed_board_bits(code: int) -> str:
    """Bits of one board square in the packed format."""
    ptype, color = code // 2, code % 2
    if ptype == 0:
        return _text_bits(*PACKED_CODES[0])
    plain = dims.UNPROMOTED.get(ptype, ptype)
    promo = "" if plain == dims.GOLD else str(int(plain != ptype))
    return _text_bits(*PACKED_CODES[plain]) + promo + str(color)


def packed_hand_bits(ptype: int, color: int, boxed: bool = False) -> str:
    promo = "" if ptype == dims.GOLD else str(int(boxed))
    return _text_bits(*PACKED_CODES[ptype])[1:] + promo + str(color)


def huffman_board_bits(code: int) -> str:
    return _text_bits(*HUFFMAN_BOARD[(code // 2, code % 2 if code > 1 else 0)])


def huffman_hand_bits(ptype: int, color: int) -> str:
    return _text_bits(*HUFFMAN_HAND[(ptype, color)])


def _number(bits: str) -> tuple[int, int]:
    return sum(1 << k for k, b in enumerate(bits) if b == "1"), len(bits)


def _put(bits: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, length: np.ndarray) -> None:
    """Write codes of up to 8 bits at their places, lowest bit first."""
    for k in range(8):
        live = length > k
        bits[rows[live], at[live] + k] = value[live] >> k & 1


def _write_codes(board: np.ndarray, hands: np.ndarray, stm: np.ndarray, kings: tuple[np.ndarray, np.ndarray], fmt: str) -> np.ndarray:
    """``(n, 32)`` bytes of boards ``(n, 81)`` and hands ``(n, 14)``, all rows in step; what runs past the record is cut off."""
    square, held = (packed_board_bits, packed_hand_bits) if fmt == "packed" else (huffman_board_bits, huffman_hand_bits)
    table = np.zeros((256, 2), np.int64)  # kings, and codes that are none, take no bits
    table[:30] = [(0, 0) if c // 2 == dims.KING else _number(square(c)) for c in range(30)]
    pieces = [_number(held(t, color)) for color in (0, 1) for t in dims.HAND_TYPES]
    n = len(board)
    value, length = np.moveaxis(table[board.view(np.uint8)], 2, 0)
    counts = np.maximum(hands.astype(np.int64), 0)
    total = 15 + length.sum(1) + counts @ np.array([m for _, m in pieces])
    bits = np.zeros((n, max(RECORD_BITS, int(total.max(initial=0))) + 8), np.uint8)
    bits[:, 0] = stm
    for first, sq in zip((1, 8), kings, strict=True):
        bits[:, first : first + 7] = sq.astype(np.int64)[:, None] >> np.arange(7) & 1
    at = 15 + np.cumsum(length, axis=1)
    _put(bits, np.repeat(np.arange(n), 81), (at - length).ravel(), value.ravel(), length.ravel())
    at = at[:, -1]
    for slot, (code, width) in enumerate(pieces):
        for j in range(int(counts[:, slot].max(initial=0))):
            rows = np.flatnonzero(counts[:, slot] > j)
            _put(bits, rows, at[rows], np.full(len(rows), code), np.full(len(rows), width))
            at[rows] += width
    return np.packbits(bits[:, :RECORD_BITS], axis=1, bitorder="little")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int8).reshape(-1, width)


def _encoded(positions: DataFrame, out: str, fmt: str) -> DataFrame:
    columns = ("board", "black_hand", "white_hand", "stm", "bk_sq", "wk_sq")

    @F.arrow_udf("binary")
    def encode(board: pa.Array, black: pa.Array, white: pa.Array, stm: pa.Array, bk: pa.Array, wk: pa.Array) -> pa.Array:
        given = [board, black, white, stm, bk, wk]
        sound = np.logical_and.reduce([np.asarray(c.is_valid()) for c in given])
        board, black, white, stm, bk, wk = (c.filter(pa.array(sound)) for c in given)
        hands = np.concatenate([_matrix(black, 7), _matrix(white, 7)], axis=1)
        raw = _write_codes(_matrix(board, 81), hands, np.asarray(stm), (np.asarray(bk), np.asarray(wk)), fmt)
        # a null row takes no bytes
        ends = pa.array(np.concatenate([[0], np.cumsum(np.where(sound, RECORD_BITS // 8, 0))]).astype(np.int32))
        mask = None if sound.all() else pa.py_buffer(np.packbits(sound, bitorder="little"))
        return pa.Array.from_buffers(pa.binary(), len(sound), [mask, ends.buffers()[1], pa.py_buffer(raw.tobytes())])

    return positions.withColumn(out, encode(*columns))


def encode_packed(positions: DataFrame, out: str = "sfen") -> DataFrame:
    """Add the 32-byte packed form of each position, a batch at a time; null where a part of the position is."""
    return _encoded(positions, out, "packed")


def encode_huffman(positions: DataFrame, out: str = "pos") -> DataFrame:
    """Add the 32-byte form of the second format, likewise."""
    return _encoded(positions, out, "huffman")


# ------------------------------------------------------------------------- decoding

BOARD_FIELDS = (
    "board array<tinyint>, black_hand array<tinyint>, white_hand array<tinyint>, "
    "stm tinyint, bk_sq tinyint, wk_sq tinyint"
)


def _window_table(entries: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each 8-bit look-ahead: the value of the code it starts with (-1: none) and its length."""
    value, length = np.full(256, -1, np.int16), np.zeros(256, np.int64)
    for bits, v in entries:
        head = sum(1 << k for k, b in enumerate(bits) if b == "1")
        for rest in range(1 << (8 - len(bits))):
            value[head | rest << len(bits)] = v
            length[head | rest << len(bits)] = len(bits)
    return value, length


BOXED = 99  # hand entry of a piece that is out of the game


def _tables(fmt: str):
    codes = [c for c in range(30) if c != 1 and c // 2 != dims.KING]
    hand = [(t, c, slot + 7 * c) for c in (0, 1) for slot, t in enumerate(dims.HAND_TYPES)]
    if fmt == "packed":
        board = [(packed_board_bits(c), c) for c in codes]
        in_hand = [(packed_hand_bits(t, c), v) for t, c, v in hand]
        in_hand += [(packed_hand_bits(t, c, True), BOXED) for t, c, _ in hand if t != dims.GOLD]
    else:
        board = [(huffman_board_bits(c), c) for c in codes]
        in_hand = [(huffman_hand_bits(t, c), v) for t, c, v in hand]
    return _window_table(board), _window_table(in_hand)


def _read_codes(raw: np.ndarray, fmt: str):
    """Decode ``(n, 32)`` bytes, all rows in step: one table lookup per square over the batch.

    Returns board, hands ``(n, 14)``, stm, kings, the final bit position and a "bad code" mask.
    """
    (bv, bl), (hv, hl) = _tables(fmt)
    n = len(raw)
    bits = np.zeros((n, RECORD_BITS + 16), np.uint8)
    bits[:, :RECORD_BITS] = np.unpackbits(raw, axis=1, bitorder="little")
    ahead = np.zeros((n, RECORD_BITS + 9), np.uint8)
    for k in range(8):
        ahead |= bits[:, k : k + RECORD_BITS + 9] << k
    stm = bits[:, 0].astype(np.int8)
    powers = 1 << np.arange(7)
    bk, wk = bits[:, 1:8] @ powers, bits[:, 8:15] @ powers
    rows = np.arange(n)
    at = np.full(n, 15, np.int64)
    board = np.zeros((n, 81), np.int8)
    bad = np.zeros(n, bool)
    for sq in range(81):
        king = (bk == sq) | (wk == sq)
        window = ahead[rows, np.minimum(at, RECORD_BITS)]
        code = bv[window]
        live = ~king & ~bad
        bad |= live & (code < 0)
        board[:, sq] = np.where(live & (code >= 0), code, 0)
        at += np.where(live, bl[window], 0)
    first, second = bk < 81, wk < 81
    board[rows[first], bk[first]] = dims.KING * 2
    board[rows[second], wk[second]] = dims.KING * 2 + 1
    hands = np.zeros((n, 15), np.int16)
    while True:
        live = (at < RECORD_BITS) & ~bad
        if not live.any():
            break
        window = ahead[rows, np.minimum(at, RECORD_BITS)]
        slot = hv[window]
        bad |= live & (slot < 0)
        live &= slot >= 0
        np.add.at(hands, (rows[live], np.where(slot[live] == BOXED, 14, slot[live])), 1)
        at += np.where(live, hl[window], 0)
    return board, hands[:, :14], stm, bk, wk, at, bad


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    flat = pa.array(np.ascontiguousarray(values, np.int8).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)


def _board_columns(decoded) -> dict[str, pa.Array]:
    board, hands, stm, bk, wk, _, _ = decoded
    return {
        "board": _lists(board),
        "black_hand": _lists(hands[:, :7]),
        "white_hand": _lists(hands[:, 7:]),
        "stm": pa.array(stm),
        "bk_sq": pa.array(bk.astype(np.int8)),
        "wk_sq": pa.array(wk.astype(np.int8)),
    }


def batch_codes(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """``(n, width)`` codes of a list column of that length; zeros where it is null."""
    lists = batch.column(batch.schema.get_field_index(column))
    out = np.zeros((len(lists), width), np.int8)
    out[np.asarray(lists.is_valid())] = _matrix(lists, width)
    return out


def _raw(batch: pa.RecordBatch, column: str) -> np.ndarray:
    data = batch.column(batch.schema.get_field_index(column)).cast(pa.binary(32))
    offset = data.offset * 32
    return np.frombuffer(data.buffers()[1], np.uint8)[offset : offset + 32 * len(data)].reshape(-1, 32)


def decode_positions(df: DataFrame, column: str = "sfen") -> DataFrame:
    """Replace the packed column by board columns. Run it after all score filters."""
    keep = [c for c in df.columns if c != column]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            cols.update(_board_columns(_read_codes(_raw(batch, column), "packed")))
            yield pa.RecordBatch.from_pydict(cols)

    return df.mapInArrow(run, f"{schema}, {BOARD_FIELDS}" if keep else BOARD_FIELDS)


ERRORS = ("king squares", "game result", "code", "256-bit boundary", "piece inventory")


def _inventory_ok(board: np.ndarray, hands: np.ndarray) -> np.ndarray:
    plain = np.array([dims.UNPROMOTED.get(c // 2, c // 2) for c in range(30)])[board]
    ok = np.ones(len(board), bool)
    for t, want in dims.INVENTORY.items():
        have = (plain == t).sum(1)
        if t in dims.HAND_TYPES:
            slot = dims.HAND_TYPES.index(t)
            have = have + hands[:, slot] + hands[:, slot + 7]
        ok &= have == want
    return ok


def decode_huffman(df: DataFrame, column: str = "pos", result: str = "result") -> DataFrame:
    """Decode the second format; ``error`` names what is wrong with a row, NULL when sound.

    The result column turns from absolute to the side to move's view. Split with
    :func:`quarantine`; erroneous rows keep their bytes in ``raw``.
    """
    keep = [c for c in df.columns if c not in (column, result)]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            raw = _raw(batch, column)
            decoded = _read_codes(raw, "huffman")
            board, hands, stm, bk, wk, at, bad = decoded
            absolute = np.asarray(batch.column(batch.schema.get_field_index(result)).cast(pa.int16()))
            checks = (
                (bk >= 81) | (wk >= 81) | (bk == wk),
                (absolute < 0) | (absolute > 2),
                bad,
                at != RECORD_BITS,
                ~_inventory_ok(board, hands),
            )
            reason = np.select(checks, range(len(ERRORS)), -1)
            wrong = reason >= 0
            names = pa.DictionaryArray.from_arrays(pa.array(np.where(wrong, reason, 0), mask=~wrong), list(ERRORS)).cast(pa.string())
            relative = np.where(absolute == 0, 0, np.where(absolute - 1 == stm, 1, -1))
            cols.update(_board_columns(decoded))
            cols["result"] = pa.array(relative.astype(np.int32))
            cols["error"] = names
            kept = pa.Array.from_buffers(pa.binary(32), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())])
            cols["raw"] = pa.compute.if_else(pa.array(wrong), kept, pa.scalar(None, pa.binary(32))).cast(pa.binary())
            yield pa.RecordBatch.from_pydict(cols)

    return df.mapInArrow(run, f"{schema}, {BOARD_FIELDS}, result int, error string, raw binary")


def quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and rejected rows with their bytes and reason."""
    return decoded.where(F.col("error").isNull()).drop("error", "raw"), decoded.where(F.col("error").isNotNull())


def write_quarantine(decoded: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Sound rows, rejected rows and how many of each reason (``sound`` for none), from one pass over the input.

    Rows go to ``path`` as one table in two folders while the counters run along in the same job.
    """
    counters = Observation()
    counted = decoded.observe(
        counters,
        F.count_if(F.col("error").isNull()).alias("sound"),
        F.count_if(~F.col("error").isin(*ERRORS)).alias("other"),
        *[F.count_if(F.col("error") == reason).alias(reason) for reason in ERRORS],
    )
    counted.withColumn("is_sound", F.col("error").isNull()).write.partitionBy("is_sound").parquet(path)
    schema = T.StructType([*decoded.schema, T.StructField("is_sound", T.BooleanType())])
    rows = decoded.sparkSession.read.schema(schema).parquet(path)
    sound, rejected = rows.where("is_sound").drop("is_sound"), rows.where("NOT is_sound").drop("is_sound")
    return sound.drop("error", "raw"), rejected, dict(counters.get)


# ------------------------------------------------------------------------- pieces


def explode_pieces(positions: DataFrame, keep: list[str], with_kings: bool = False) -> DataFrame:
    """One row per board piece: ``keep`` plus ``sq, code, ptype, color``; no shuffle."""
    rows = positions.select(*keep, F.posexplode("board").alias("sq", "code"))
    rows = rows.where(F.col("code") > 1)
    rows = rows.select(
        *keep, "sq", F.col("code").cast("int").alias("code"),
        F.shiftright(F.col("code").cast("int"), 1).alias("ptype"), (F.col("code").cast("int") % 2).alias("color"),
    )
    return rows if with_kings else rows.where(F.col("ptype") != dims.KING)


# ------------------------------------------------------------------------- text positions


def _letter(code: int) -> str:
    ptype, color = code // 2, code % 2
    plain = dims.UNPROMOTED.get(ptype, ptype)
    name = next(k for k, v in dims.LETTERS.items() if v == plain)
    return ("+" if plain != ptype else "") + (name if color == 0 else name.lower())


def _ranks_text(boards: np.ndarray) -> pa.Array:
    """Ranks of ``(n, 81)`` codes as text, file 9 first, with a 1 for every empty square."""
    cells = np.zeros((30, 2), np.uint8)
    for c in range(30):
        name = ("1" if c < 2 else _letter(c)).encode()
        cells[c, : len(name)] = list(name)
    text = np.zeros((len(boards), 9, 10, 2), np.uint8)  # zeros are left out below
    text[:, :, :9] = cells[boards.reshape(-1, 9, 9)[:, ::-1].transpose(0, 2, 1)]
    text[:, :8, 9, 0] = ord("/")
    text = text.reshape(len(boards), -1)
    ends = np.concatenate(([0], np.cumsum(np.count_nonzero(text, axis=1)))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(boards), [None, pa.py_buffer(ends), pa.py_buffer(text[text > 0].tobytes())])


def to_sfen(positions: DataFrame, out: str = "sfen_text") -> DataFrame:
    """Add the text form of each position (board, side, hands, ply)."""

    @F.arrow_udf("string")
    def ranks(boards: pa.Array) -> pa.Array:
        there = np.asarray(boards.is_valid())
        text = _ranks_text(_matrix(boards, 81))
        return text if there.all() else text.take(pa.array(np.cumsum(there) - 1, mask=~there))

    board = F.coalesce(ranks("board"), F.lit(""))
    for n in range(9, 1, -1):
        board = F.replace(board, F.lit("1" * n), F.lit(str(n)))

    def held(hand: str, color: int) -> list[Column]:
        out = []
        for slot, t in enumerate(dims.HAND_TYPES):
            n = F.get(F.col(hand), F.lit(slot)).cast("int")
            name = _letter(t * 2 + color)
            out.append(F.when(n == 0, "").when(n == 1, name).otherwise(F.concat(n.cast("string"), F.lit(name))))
        return out

    hands = F.concat(*held("black_hand", 0), *held("white_hand", 1))
    side = F.when(F.col("stm") == 0, "b").otherwise("w")
    return positions.withColumn(
        out, F.concat_ws(" ", board, side, F.when(hands == "", "-").otherwise(hands), F.col("ply").cast("string"))
    )


START_POSITION = "lnsgkgsnl/1r5b1/ppppppppp/9/9/9/PPPPPPPPP/1B5R1/LNSGKGSNL b - 1"



def _list_array(values: np.ndarray, null: np.ndarray) -> pa.Array:
    """Rows of ``values`` as lists, one for every row that is not null."""
    ends = pa.array(np.concatenate(([0], np.cumsum(~null) * values.shape[1])).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values, np.int8).ravel()), mask=pa.array(null) if null.any() else None)


def _board_of(dotted: Column) -> Column:
    """Codes of nine sound ranks of nine squares each, where digits are dots already; null for null."""
    plain, raised = np.full(256, -1, np.int16), np.zeros(256, np.int16)
    plain[ord(".")] = 0
    for c in range(2, 30):
        (raised if c // 2 in dims.UNPROMOTED else plain)[ord(_letter(c)[-1])] = c

    @F.arrow_udf("array<tinyint>")
    def codes(text: pa.Array) -> pa.Array:
        null = ~np.asarray(text.is_valid())
        flat = np.frombuffer("".join(text.drop_null().to_pylist()).encode(), np.uint8)
        at = np.flatnonzero(plain[flat] >= 0)
        after_sign = np.concatenate(([0], flat[:-1]))[at] == ord("+")
        values = np.where(after_sign, raised[flat[at]], plain[flat[at]])
        # ranks run left to right (file 9 first); squares run file by file
        return _list_array(values.reshape(-1, 9, 9)[:, :, ::-1].transpose(0, 2, 1).reshape(-1, 81), null)

    return codes(dotted)


def _hands_of(hand: Column) -> Column:
    """Both hands' counts, seven each, of a sound hand text; null for null. A count is 1 at least and 127 at most."""
    slots = {_letter(t * 2 + c): slot + 7 * c for c in (0, 1) for slot, t in enumerate(dims.HAND_TYPES)}

    @F.arrow_udf("array<tinyint>")
    def counts(text: pa.Array) -> pa.Array:
        held = text.drop_null().to_pylist()
        values = np.zeros((len(held), 14), np.int64)
        for row, t in enumerate(held):
            for n, letter in re.findall(r"([0-9]*)([PLNSGBRplnsgbr])", t):
                n = n.lstrip("0")  # none, or more than an integer holds, counts as one
                values[row, slots[letter]] += int(n) if 0 < len(n) < 11 and int(n) < 1 << 31 else 1
        return _list_array(np.minimum(values, 127), ~np.asarray(text.is_valid()))

    return counts(hand)


def parse_sfen(df: DataFrame, column: str = "sfen_text") -> DataFrame:
    """Text positions to board rows, with ``error`` (NULL when sound) and ``ply``.

    Accepts ``startpos``, ``sfen …`` and bare forms, an optional leading ``position`` and a
    trailing ``moves …`` list. Digits become that many empty squares; what is wrong is found in native
    columns, and sound texts turn into codes a batch at a time.
    """
    text = F.trim(F.regexp_replace(F.trim(F.col(column)), r"^position\s+", ""))
    df = df.withColumn("_t", F.when(text.isin("", "position"), F.lit("startpos")).otherwise(text))
    # text up to " moves ", and the moves behind it
    head = F.trim(F.regexp_replace("_t", r"(^|\s)moves(\s.*)?$", ""))
    head = F.when(head == "startpos", F.lit(START_POSITION)).otherwise(F.regexp_replace(head, r"^sfen\s+", ""))
    moves = F.trim(F.regexp_extract("_t", r"(?:^|\s)moves\s+(.*)$", 1))
    df = df.withColumn("_moves", F.when(moves == "", F.array().cast("array<string>")).otherwise(F.split(moves, r"\s+")))
    df = bind(df, "_f", F.split(head, r"\s+"))
    board, side, hand, ply = (F.get(F.col("_f"), F.lit(i)) for i in range(4))
    dotted = board
    for n in range(1, 10):
        dotted = F.replace(dotted, F.lit(str(n)), F.lit("." * n))
    df = bind(df, "_dotted", dotted)
    # squares of each rank: a sign of promotion takes none, a zero counts none
    df = bind(df, "_squares", F.transform(F.split(F.translate("_dotted", "+0", ""), "/"), F.length))
    holds = lambda pattern: F.col("_dotted").rlike(pattern)
    hand_ok = (hand == "-") | hand.rlike(r"^(\d*[PLNSGBRplnsgbr])+$")
    board_error = (
        F.when(F.size("_squares") != 9, "ranks")
        .when(F.contains("_dotted", F.lit("++")), "promotion twice")
        .when(F.contains("_dotted", F.lit("+.")), "promotion of nothing")
        .when(holds(r"\+(/|$)"), "promotion at end")
        .when(holds(r"[^PLNSGBRKplnsgbrk+.0/]"), "piece letter")
        .when(F.array_max("_squares") > 9, "long rank")
        .when(F.array_min("_squares") < 9, "short rank")
    )
    error = (
        F.when(board.isNull() | (board == ""), "no board")
        .when(side.isNull(), "no side")
        .when(hand.isNull(), "no hand")
        .when(ply.isNull(), "no ply")
        .when(~side.isin("b", "w"), "side letter")
        .when(F.expr("try_cast(get(_f, 3) as int)").isNull() | ~F.expr("try_cast(get(_f, 3) as int)").between(0, 65535), "ply number")
        .otherwise(F.coalesce(board_error, F.when(~hand_ok, "hand letters")))
    )
    df = bind(df, "error", error)
    good = F.col("error").isNull()
    df = bind(df, "board", _board_of(F.when(good, F.col("_dotted"))))
    df = bind(df, "_hands", _hands_of(F.when(good, hand)))
    df = df.withColumns(
        {
            "black_hand": F.slice("_hands", 1, 7),
            "white_hand": F.slice("_hands", 8, 7),
            "stm": F.when(good, F.when(side == "b", 0).otherwise(1)).cast("tinyint"),
            "ply": F.expr("try_cast(get(_f, 3) as int)"),
        }
    )
    king = lambda code: (F.array_position("board", F.lit(code).cast("tinyint")) - 1).cast("tinyint")
    none = F.lit(81).cast("tinyint")
    df = df.withColumns(
        {
            "bk_sq": F.when(king(dims.KING * 2) >= 0, king(dims.KING * 2)).otherwise(none),
            "wk_sq": F.when(king(dims.KING * 2 + 1) >= 0, king(dims.KING * 2 + 1)).otherwise(none),
        }
    )
    return df.drop("_t", "_f", "_dotted", "_squares", "_hands").withColumnRenamed("_moves", "moves")


def _square(text: str) -> str:
    return f"((ascii(substring({text}, 1, 1)) - 49) * 9 + ascii(substring({text}, 2, 1)) - 97)"


def apply_moves(df: DataFrame) -> DataFrame:
    """Play each row's ``moves`` onto its board; ``error`` names the first bad move.

    A fold over the move list with the whole position as its state: rows never meet.
    """
    promote = "array(" + ",".join(str(2 * dims.PROMOTED.get(c // 2, c // 2) + c % 2) for c in range(30)) + ")"
    plain = "array(" + ",".join(str(dims.UNPROMOTED.get(c // 2, c // 2)) for c in range(30)) + ")"
    slots = "array(" + ",".join(str(dims.HAND_TYPES.index(t)) if t in dims.HAND_TYPES else "-1" for t in range(9)) + ")"
    types = "array(" + ",".join(str(t) for t in dims.HAND_TYPES) + ")"
    letters = "'" + "".join(next(k for k, v in dims.LETTERS.items() if v == t) for t in dims.HAND_TYPES) + "'"
    state = (
        "named_struct('board', transform(board, x -> CAST(x AS INT)), "
        "'hands', array(transform(black_hand, x -> CAST(x AS INT)), transform(white_hand, x -> CAST(x AS INT))), "
        "'stm', CAST(stm AS INT), 'ply', ply, 'error', error)"
    )
    # m: the move cut into parts. slot: hand slot of a drop, -1 for a board move.
    parts = (
        "transform(moves, m -> named_struct('text', m, "
        r"'ok', m RLIKE '^([1-9][a-i]|[PLNSGBR]\\*)[1-9][a-i]\\+?$', "
        f"'slot', CASE WHEN substring(m, 2, 1) = '*' THEN instr({letters}, substring(m, 1, 1)) - 1 ELSE -1 END, "
        f"'fr', CASE WHEN substring(m, 2, 1) = '*' THEN -1 ELSE {_square('m')} END, "
        f"'to', {_square('substring(m, 3, 2)')}, 'up', m LIKE '%+'))"
    )
    moving = (
        f"CASE WHEN m.slot >= 0 THEN 2 * get({types}, m.slot) + s.stm "
        f"WHEN m.up THEN get({promote}, get(s.board, m.fr)) ELSE get(s.board, m.fr) END"
    )
    bad = (
        "CASE WHEN NOT m.ok THEN concat('move text: ', m.text) "
        "WHEN m.slot >= 0 AND get(get(s.hands, s.stm), m.slot) = 0 THEN concat('nothing to drop: ', m.text) "
        "WHEN m.slot < 0 AND get(s.board, m.fr) < 2 THEN concat('nothing to move: ', m.text) END"
    )
    taken = f"get({slots}, get({plain}, get(s.board, m.to)))"
    step = (
        f"(s, m) -> CASE WHEN s.error IS NOT NULL THEN s WHEN ({bad}) IS NOT NULL THEN "
        f"named_struct('board', s.board, 'hands', s.hands, 'stm', s.stm, 'ply', s.ply, 'error', {bad}) "
        "ELSE named_struct("
        f"'board', transform(s.board, (x, i) -> CASE WHEN i = m.to THEN {moving} WHEN i = m.fr THEN 0 ELSE x END), "
        "'hands', transform(s.hands, (h, o) -> CASE WHEN o <> s.stm THEN h ELSE transform(h, (n, k) -> "
        f"n + CASE WHEN get(s.board, m.to) >= 2 AND k = {taken} THEN 1 ELSE 0 END - CASE WHEN k = m.slot THEN 1 ELSE 0 END) END), "
        "'stm', 1 - s.stm, 'ply', s.ply + 1, 'error', s.error) END"
    )
    df = bind(df, "_parts", F.expr(parts))
    # a row without moves stays as it is
    df = bind(df, "_s", F.expr(f"CASE WHEN size(_parts) > 0 THEN aggregate(_parts, {state}, {step}) END"))
    king = lambda code: f"CAST(CASE WHEN array_position(_s.board, {code}) > 0 THEN array_position(_s.board, {code}) - 1 ELSE 81 END AS TINYINT)"
    played = {
        "board": "transform(_s.board, x -> CAST(x AS TINYINT))",
        "black_hand": "transform(_s.hands[0], x -> CAST(x AS TINYINT))",
        "white_hand": "transform(_s.hands[1], x -> CAST(x AS TINYINT))",
        "stm": "CAST(_s.stm AS TINYINT)",
        "ply": "_s.ply",
        "error": "_s.error",
        "bk_sq": king(dims.KING * 2),
        "wk_sq": king(dims.KING * 2 + 1),
    }
    return df.withColumns({c: F.expr(f"CASE WHEN _s IS NULL THEN {c} ELSE {x} END") for c, x in played.items()}).drop("_parts", "_s", "moves")


def sfen_to_positions(df: DataFrame, column: str = "sfen_text") -> DataFrame:
    """Text positions with optional move lists to board rows plus ``error``."""
    return apply_moves(parse_sfen(df, column))
