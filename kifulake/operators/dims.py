"""Static dimensions of the game: pieces, moves, reach, pair ranges. All are small and fixed.

Every table here has a size set by the rules, independent of the corpus, so operators may broadcast them.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binding import bind

# Piece type numbers.
PAWN, LANCE, KNIGHT, SILVER, BISHOP, ROOK, GOLD, KING = range(1, 9)
PRO_PAWN, PRO_LANCE, PRO_KNIGHT, PRO_SILVER, HORSE, DRAGON = range(9, 15)
HAND_TYPES = (PAWN, LANCE, KNIGHT, SILVER, GOLD, BISHOP, ROOK)
UNPROMOTED = {PRO_PAWN: PAWN, PRO_LANCE: LANCE, PRO_KNIGHT: KNIGHT, PRO_SILVER: SILVER, HORSE: BISHOP, DRAGON: ROOK}
PROMOTED = {v: k for k, v in UNPROMOTED.items()}
INVENTORY = {PAWN: 18, LANCE: 4, KNIGHT: 4, SILVER: 4, GOLD: 4, BISHOP: 2, ROOK: 2, KING: 2}
LETTERS = {"P": PAWN, "L": LANCE, "N": KNIGHT, "S": SILVER, "B": BISHOP, "R": ROOK, "G": GOLD, "K": KING}

# Piece-square code layout. Codes below 90 are hand pieces, then one block of
# 81 squares per (type, friend/enemy), then the friendly and the enemy king block.
HAND_BASE = {  # type: (friend, enemy)
    PAWN: (1, 20), LANCE: (39, 44), KNIGHT: (49, 54), SILVER: (59, 64),
    GOLD: (69, 74), BISHOP: (79, 82), ROOK: (85, 88),
}
HAND_END = 90
BOARD_ORDER = (PAWN, LANCE, KNIGHT, SILVER, GOLD, BISHOP, HORSE, ROOK, DRAGON)
BOARD_END = HAND_END + 2 * 81 * len(BOARD_ORDER)  # 1548
FRIEND_KING, ENEMY_KING = BOARD_END, BOARD_END + 81

# Centipawn worth of a piece.
WORTH = {
    PAWN: 100.0, LANCE: 300.0, KNIGHT: 320.0, SILVER: 500.0, GOLD: 550.0,
    BISHOP: 850.0, ROOK: 1000.0, HORSE: 1020.0, DRAGON: 1200.0,
}

# Edge classes; promoted minor pieces move, and count, as gold.
CLASS_NAMES = ("Pawn", "Lance", "Knight", "Silver", "GoldLike", "Bishop", "Rook", "Horse", "Dragon")
CLASS_TYPE = (PAWN, LANCE, KNIGHT, SILVER, GOLD, BISHOP, ROOK, HORSE, DRAGON)
SLIDER_CLASSES = (1, 5, 6, 7, 8)
BIG_SLIDER_CLASSES = (5, 6, 7, 8)
GOLD_MOVERS = (GOLD, PRO_PAWN, PRO_LANCE, PRO_KNIGHT, PRO_SILVER)

# Moves as (file step, rank step) of the first player, who moves toward lower ranks.
_ORTHOGONAL = ((-1, 0), (1, 0), (0, -1), (0, 1))
_DIAGONAL = ((-1, -1), (-1, 1), (1, -1), (1, 1))
_AHEAD = ((-1, -1), (0, -1), (1, -1))
STEPS = {
    PAWN: ((0, -1),),
    KNIGHT: ((-1, -2), (1, -2)),
    SILVER: _AHEAD + ((-1, 1), (1, 1)),
    GOLD: _AHEAD + ((-1, 0), (1, 0), (0, 1)),
    KING: _ORTHOGONAL + _DIAGONAL,
    HORSE: _ORTHOGONAL,
    DRAGON: _DIAGONAL,
}
SLIDES = {LANCE: ((0, -1),), BISHOP: _DIAGONAL, ROOK: _ORTHOGONAL, HORSE: _DIAGONAL, DRAGON: _ORTHOGONAL}


def movement_type(ptype: int) -> int:
    return GOLD if ptype in GOLD_MOVERS else ptype


def class_of(ptype: int) -> int | None:
    """Edge class of a piece type; kings have none."""
    t = movement_type(ptype)
    return CLASS_TYPE.index(t) if t in CLASS_TYPE else None


def _walk(sq: int, df: int, dr: int, far: bool) -> list[int]:
    path, f, r = [], sq // 9 + df, sq % 9 + dr
    while 0 <= f < 9 and 0 <= r < 9:
        path.append(f * 9 + r)
        if not far:
            break
        f, r = f + df, r + dr
    return path


@functools.cache
def rays_of(ptype: int, color: int, sq: int) -> tuple[tuple[int, ...], ...]:
    """Empty-board paths of a piece, nearest square first, one per direction."""
    t, flip = movement_type(ptype), (1 if color == 0 else -1)
    out = []
    for moves, far in ((STEPS, False), (SLIDES, True)):
        for df, dr in moves.get(t, ()):
            path = _walk(sq, df, dr * flip, far)
            if path:
                out.append(tuple(path))
    return tuple(out)


def _frame(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array(v, types[k]) for k, v in columns.items()}))


def _rows(spark: SparkSession, names: str, rows, types: dict[str, pa.DataType] | None = None) -> DataFrame:
    keys = names.split()
    kinds = {k: (types or {}).get(k, pa.int32()) for k in keys}
    return _frame(spark, {k: [r[i] for r in rows] for i, k in enumerate(keys)}, kinds)


def rays(spark: SparkSession) -> DataFrame:
    """``(code, from_sq, path)`` for every piece that can move, kings included."""
    out = [
        (t * 2 + c, sq, list(path))
        for t in range(1, 15)
        for c in (0, 1)
        for sq in range(81)
        for path in rays_of(t, c, sq)
    ]
    return F.broadcast(_rows(spark, "code from_sq path", out, {"path": pa.list_(pa.int32())}))


def reach_rows() -> list[tuple[int, int, int, int, int]]:
    """(class, color, from, to, offset): empty-board attacks and their place in the class block.

    The offset counts (from, to) pairs of the oriented class in square order.
    """
    out = []
    for cls, t in enumerate(CLASS_TYPE):
        for color in (0, 1):
            offset = 0
            for sq in range(81):
                for to in sorted(s for path in rays_of(t, color, sq) for s in path):
                    out.append((cls, color, sq, to, offset))
                    offset += 1
    return out


def reach(spark: SparkSession) -> DataFrame:
    return F.broadcast(_rows(spark, "cls color from_sq to_sq offset", reach_rows()))


def class_widths() -> list[int]:
    """Edges of each class on an empty board over all squares (one color)."""
    return [sum(1 for r in reach_rows() if r[0] == c and r[1] == 0) for c in range(len(CLASS_TYPE))]


def class_column(code: Column) -> Column:
    """Edge class of a board code; NULL for kings and empty squares."""
    table = [class_of(c // 2) if c // 2 not in (0, KING) else None for c in range(30)]
    return F.get(F.array(*[F.lit(v).cast("int") for v in table]), code)


# Edge profiles and what each leaves out. Sides are 0 friend, 1 enemy.
PROFILES = ("full", "same-class", "same-class-major-pawn", "step-attacker", "full-symdedup", "cross-side")


def excluded(profile: str, attacker_side: Column, ac: Column, attacked_side: Column, dc: Column) -> Column:
    """Whether a profile leaves out the (side, class, side, class) pair."""
    if profile not in PROFILES:
        raise ValueError(f"unknown edge profile {profile!r}")
    same = ac == dc
    if profile == "same-class":
        return same
    if profile == "same-class-major-pawn":
        return same | ((ac >= 5) & (dc == 0))
    if profile == "step-attacker":
        return ac.isin(*SLIDER_CLASSES)
    if profile == "cross-side":
        return (attacker_side == attacked_side) | same
    return F.lit(False)


def edge_pair_ranges(widths: DataFrame, n_classes: int, profile: str) -> DataFrame:
    """Feature ranges ``[base, base + width)`` of the pairs a profile keeps.

    ``widths`` has one row per attacker class ``(ac, width)``; the pair list is 4 n² rows.
    """
    sides = F.array(F.lit(0), F.lit(1))
    pairs = (
        widths.withColumn("attacker_side", F.explode(sides))
        .withColumn("attacked_side", F.explode(sides))
        .withColumn("dc", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))))
    )
    pairs = pairs.where(~excluded(profile, F.col("attacker_side"), F.col("ac"), F.col("attacked_side"), F.col("dc")))
    order = Window.orderBy("attacker_side", "ac", "attacked_side", "dc").rowsBetween(Window.unboundedPreceding, -1)
    return pairs.select(
        "attacker_side", "ac", "attacked_side", "dc", "width",
        F.coalesce(F.sum("width").over(order), F.lit(0)).cast("bigint").alias("base"),
    )


def pair_ranges(spark: SparkSession, profile: str) -> DataFrame:
    """The game's own pair ranges."""
    widths = _rows(spark, "ac width", list(enumerate(class_widths())))
    return edge_pair_ranges(widths, len(CLASS_TYPE), profile)


_PAIRS: dict[str, list] = {}


def pair_list(spark: SparkSession, profile: str) -> list:
    """The rows of :func:`pair_ranges` by ``base``, at most 324, worked out once."""
    if profile not in _PAIRS:
        _PAIRS[profile] = sorted(pair_ranges(spark, profile).collect(), key=lambda r: r.base)
    return _PAIRS[profile]


PAIR_KEY = ("attacker_side", "ac", "attacked_side", "dc")


def with_pair(rows: DataFrame, profile: str, row: str = "row") -> DataFrame:
    """Add the pair (:data:`PAIR_KEY`) whose range holds the feature number in ``row``, without a join.

    Bisection over the bases of the pairs (at most 324, a literal of the plan); a number that the
    profile does not have fails the job.
    """
    pairs = pair_list(rows.sparkSession, profile)
    bases = F.array(*[F.lit(r.base) for r in pairs])
    size = pairs[-1].base + pairs[-1].width
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(pairs).bit_length()))])
    number = F.col(row).cast("bigint")
    outside = F.raise_error(F.format_string(f"feature row %s is outside profile {profile} of {size} rows", F.coalesce(number.cast("string"), F.lit("null")))).cast("int")
    found = F.aggregate(steps, F.lit(-1), lambda at, step: F.when(F.get(bases, at + step) <= number, at + step).otherwise(at))
    rows = bind(rows, "_pair", F.when(number.between(0, size - 1), found).otherwise(outside))
    parts = {k: F.get(F.array(*[F.lit(r[k]) for r in pairs]), F.col("_pair")) for k in PAIR_KEY}
    return rows.withColumns(parts).drop("_pair")
