"""Score filters, bands, sampling and guards."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.hashing import with_unit24


def score_drop(df: DataFrame, threshold: int) -> DataFrame:
    """Drop rows with abs(score) >= threshold."""
    return df.where(scores.magnitude(F.col("score")) < threshold)


def score_clamp(df: DataFrame, bound: int) -> DataFrame:
    """Saturate the score to ±bound. Apply after :func:`score_drop`."""
    return df.withColumn("score", scores.clamp(F.col("score"), bound))


def float32(x: float) -> float:
    """``x`` rounded to single precision, as a Python float."""
    return struct.unpack("<f", struct.pack("<f", x))[0]


def parse_bands(text: str) -> list[tuple[float, float]]:
    """``"1500:1.0,3000:0.3,inf:0.1"`` to ``[(upper, probability), ...]``.

    Uppers must rise strictly and end in ``inf`` (in any case); probabilities lie in (0, 1].
    """
    bands: list[tuple[float, float]] = []
    entries = [e.strip() for e in text.split(",")]
    for i, entry in enumerate(entries):
        upper_text, colon, p_text = entry.partition(":")
        if not colon:
            raise ValueError(f"band {entry!r} is not of the form upper:probability")
        upper_text = upper_text.strip()
        last = i == len(entries) - 1
        if upper_text.lower() == "inf":
            if not last:
                raise ValueError("inf must be the last band")
            upper = math.inf
        else:
            if not upper_text.isdigit():
                raise ValueError(f"band bound {upper_text!r} is not a non-negative integer")
            upper = int(upper_text)
            if last:
                raise ValueError("the last band must be inf")
            if bands and upper <= bands[-1][0]:
                raise ValueError("band bounds must rise strictly")
        try:
            p = float32(float(p_text.strip()))
        except ValueError as bad:
            raise ValueError(f"band probability {p_text!r} is not a number") from bad
        if not 0.0 < p <= 1.0:
            raise ValueError(f"band probability {p_text!r} is not in (0, 1]")
        bands.append((upper, p))
    return bands


def band_table(configs: DataFrame, spec: str = "spec") -> DataFrame:
    """Expand a column of band texts into ``(…, band, lower_excl, upper_incl, p, valid)`` rows.

    The relational form of :func:`parse_bands` for a table of configurations: ``valid`` says
    whether the whole text obeys the rules. ``upper_incl`` is NULL for ``inf``.
    """
    keys = configs.columns
    rows = configs.select(*keys, F.posexplode(F.split(spec, ",")).alias("band", "_entry"))
    parts = F.split(F.trim("_entry"), ":")
    rows = rows.select(
        *keys,
        "band",
        F.trim(F.get(parts, F.lit(0))).alias("_upper"),
        F.expr("try_cast(trim(get(split(trim(_entry), ':'), 1)) as float)").alias("p"),
        F.size(F.split(spec, ",")).alias("_n"),
        (F.size(parts) == 2).alias("_shape"),
    )
    rows = rows.withColumn("upper_incl", F.expr("try_cast(_upper as int)"))
    order = Window.partitionBy(*keys).orderBy("band")
    everything = Window.partitionBy(*keys)
    rows = rows.withColumn("lower_excl", F.lag("upper_incl").over(order))
    last = F.col("band") == F.col("_n") - 1
    ok = (
        F.col("_shape")
        & F.col("p").isNotNull()
        & (F.col("p") > 0)
        & (F.col("p") <= 1)
        & F.when(last, F.lower("_upper") == "inf").otherwise(
            F.col("upper_incl").isNotNull() & (F.col("upper_incl") >= 0)
        )
        & (last | F.col("lower_excl").isNull() | (F.col("upper_incl") > F.col("lower_excl")))
        & (last | (F.col("band") == 0) | F.col("lower_excl").isNotNull())
    )
    rows = rows.withColumn("valid", F.min(F.coalesce(ok, F.lit(False))).over(everything))
    return rows.select(*keys, "band", "lower_excl", "upper_incl", "p", "valid")


def keep_probability(score: Column, bands: list[tuple[float, float]]) -> Column:
    """Probability of the first band with abs(score) <= upper; mate stamps take the last band."""
    a = scores.magnitude(score)
    out = F.lit(bands[-1][1])
    for upper, p in reversed(bands[:-1]):
        out = F.when(a <= int(upper), F.lit(p)).otherwise(out)
    return F.when(a >= scores.MATE_STAMP, F.lit(bands[-1][1])).otherwise(out)


def draw_limit(score: Column, bands: list[tuple[float, float]]) -> Column:
    """The integer threshold a 24-bit draw must stay below to be kept."""
    as_draws = [(u, math.ceil(p * (1 << 24))) for u, p in bands]
    return keep_probability(score, as_draws)  # type: ignore[arg-type]


def importance_weight(score: Column, bands: list[tuple[float, float]], beta: float) -> Column:
    """keep probability ** -beta."""
    if not 0.0 <= beta <= 1.0:
        raise ValueError("beta must be in [0, 1]")
    return F.pow(keep_probability(score, bands), F.lit(-float32(beta)))


def band_sample(
    df: DataFrame,
    bands: list[tuple[float, float]],
    seed: int,
    epoch: int | Column = 0,
    beta: float = 0.0,
    index_col: str = "rec_idx",
    keep_draw: bool = False,
) -> DataFrame:
    """Keep each row with its band's probability, decided by a hash of (seed, index, epoch).

    Needs no shuffle and gives the same rows on every run. ``weight`` is added when beta != 0.
    """
    drawn = with_unit24(df, index_col, seed, epoch)
    kept = drawn.where(F.col("u24") < draw_limit(F.col("score"), bands))
    if beta != 0.0:
        kept = kept.withColumn("weight", importance_weight(F.col("score"), bands, beta))
    return kept if keep_draw else kept.drop("u24")


class EmptySourceError(RuntimeError):
    """A source that yields no usable row."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself, or :class:`EmptySourceError` when it has no row."""
    if df.isEmpty():
        raise EmptySourceError(f"{what}: no usable rows")
    return df


def guarded_count(df: DataFrame, what: str) -> DataFrame:
    """The row count as a lazy one-row table whose evaluation fails when it is zero."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n")).select(
        F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit(f"{what}: no usable rows")).cast("bigint")).alias("n")
    )
