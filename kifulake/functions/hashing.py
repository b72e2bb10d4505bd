"""64-bit wrapping arithmetic and the hashes built on it, as native columns.

ANSI mode makes ``bigint * bigint`` overflow an error, so products are formed from limbs
that stay inside a signed 64-bit integer. Intermediates are used several times, and a filter
on the result would be pushed through plain projections with all of them substituted, which
grows the predicate exponentially; :func:`~kifulake.functions.binding.bind` stops that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import bind

MASK32 = 0xFFFFFFFF
MASK64 = (1 << 64) - 1

# Fixed values of the sampling hash (splitmix64 finaliser and its two stream constants).
INDEX_MULTIPLIER = 0x9E3779B97F4A7C15
EPOCH_MULTIPLIER = 0xD1B54A32D192ED03
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB

# Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET = 0x811C9DC5
FNV_PRIME = 0x01000193


def signed64(value: int) -> int:
    """The signed 64-bit integer with the same bits as ``value`` mod 2^64."""
    value &= MASK64
    return value - (1 << 64) if value >> 63 else value


def _low32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK32).cast("long"))


def _high32(c: Column) -> Column:
    return F.shiftrightunsigned(c, 32)


def wrapping_add(a: Column, constant: int) -> Column:
    """``a + constant`` mod 2^64 for a bigint column and a Python integer."""
    constant &= MASK64
    low = _low32(a) + F.lit(constant & MASK32).cast("long")
    high = _high32(a) + F.lit(constant >> 32).cast("long") + _high32(low)
    return F.shiftleft(_low32(high), 32).bitwiseOR(_low32(low))


def wrapping_multiply(df: DataFrame, source: str, constant: int, out: str) -> DataFrame:
    """Add ``out = source * constant`` mod 2^64 (bigint bit pattern)."""
    constant &= MASK64
    limb0 = F.lit(constant & 0xFFFF).cast("long")
    limb1 = F.lit((constant >> 16) & 0xFFFF).cast("long")
    high_const = constant >> 32
    x = F.col(source)
    df = df.withColumns({"_lo": _low32(x), "_hi": _high32(x)})
    lo, hi = F.col("_lo"), F.col("_hi")
    # Low product as base-2^16 columns: each factor stays below 2^48.
    df = df.withColumns(
        {
            "_p0": lo * limb0,
            "_p1": lo * limb1,
            # cross terms only matter mod 2^32; 16-bit limbs of the constant keep them small
            "_cross": _low32(lo * F.lit(high_const & 0xFFFF).cast("long"))
            + F.shiftleft((lo * F.lit(high_const >> 16).cast("long")).bitwiseAND(F.lit(0xFFFF)), 16)
            + _low32(hi * limb0)
            + F.shiftleft((hi * limb1).bitwiseAND(F.lit(0xFFFF)), 16),
        }
    ).drop("_lo", "_hi")
    df = df.withColumn("_low", _low32(F.col("_p0")) + F.shiftleft(F.col("_p1").bitwiseAND(F.lit(0xFFFF)), 16))
    high = (
        F.shiftrightunsigned("_p0", 32)
        + F.shiftrightunsigned("_p1", 16)
        + _high32(F.col("_low"))
        + F.col("_cross")
    )
    product = F.shiftleft(_low32(high), 32).bitwiseOR(_low32(F.col("_low")))
    return bind(df, out, product).drop("_p0", "_p1", "_cross", "_low")


def with_unit24(
    df: DataFrame, index_col: str, seed: int, epoch: int | Column = 0, out: str = "u24"
) -> DataFrame:
    """Add ``out``: a deterministic draw in ``[0, 2^24)`` for (seed, record index, epoch).

    ``epoch`` is a Python integer, or a bigint column that already holds
    ``epoch_term(epoch)`` (see :func:`epoch_term`).
    """
    df = wrapping_multiply(df, index_col, INDEX_MULTIPLIER, "_h")
    if isinstance(epoch, int):
        mixed = F.col("_h").bitwiseXOR(F.lit(signed64(seed ^ epoch_term(epoch))))
    else:
        mixed = F.col("_h").bitwiseXOR(F.lit(signed64(seed))).bitwiseXOR(epoch)
    df = bind(df, "_h", wrapping_add(mixed, GAMMA))
    df = bind(df, "_h", F.col("_h").bitwiseXOR(F.shiftrightunsigned("_h", 30)))
    df = wrapping_multiply(df, "_h", MIX_1, "_h")
    df = bind(df, "_h", F.col("_h").bitwiseXOR(F.shiftrightunsigned("_h", 27)))
    df = wrapping_multiply(df, "_h", MIX_2, "_h")
    # (v ^ (v >> 31)) >> 40
    return bind(
        df, out, F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.shiftrightunsigned("_h", 31)), 40)
    ).drop("_h")


def epoch_term(epoch: int) -> int:
    """The epoch's contribution to the sampling hash, as a signed 64-bit value."""
    return signed64(epoch * EPOCH_MULTIPLIER)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of a string column's bytes, as bigint."""
    data = F.encode(text, "UTF-8")
    positions = F.sequence(F.lit(1), F.octet_length(data))
    step = lambda acc, i: (  # noqa: E731 - one expression, used once
        acc.bitwiseXOR(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
        * F.lit(FNV_PRIME).cast("long")
    ).bitwiseAND(F.lit(MASK32).cast("long"))
    return F.when(F.octet_length(data) == 0, F.lit(FNV_OFFSET).cast("long")).otherwise(
        F.aggregate(positions, F.lit(FNV_OFFSET).cast("long"), step)
    )
