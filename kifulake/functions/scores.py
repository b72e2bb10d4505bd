"""Score, result and loss expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATE_STAMP = 32000  # scores of this magnitude and above mark a forced mate


def r(c: Column, digits: int = 6) -> Column:
    """Rounded to ``digits`` with negative zero folded into zero."""
    return F.round(c, digits) + F.lit(0.0)


def magnitude(score: Column) -> Column:
    """abs(score), widened first: the most negative 16-bit value has no 16-bit abs."""
    return F.abs(score.cast("int"))


def clamp(score: Column, bound: int) -> Column:
    return F.greatest(F.least(score.cast("int"), F.lit(bound)), F.lit(-bound))


def result_to_wdl(result: Column) -> Column:
    """1 for a win, 0.5 for a draw, 0 for a loss of the side to move."""
    return F.when(result > 0, 1.0).when(result == 0, 0.5).otherwise(0.0)


def result_name(result: Column) -> Column:
    return F.when(result > 0, "Win").when(result < 0, "Loss").otherwise("Draw")


def absolute_to_relative(absolute: Column, stm: Column) -> Column:
    """Absolute outcome (0 draw, 1 first player won, 2 second player won) to side-to-move view.

    Anything else is NULL, which the quarantine turns into an error row.
    """
    return (
        F.when(absolute == 0, 0)
        .when(absolute.isin(1, 2), F.when((absolute - 1) == stm, 1).otherwise(-1))
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def win_rate(score: Column, offset: float, scaling: float) -> Column:
    """Symmetric two-sigmoid win rate of a score."""
    up = sigmoid((score - F.lit(offset)) / F.lit(scaling))
    down = sigmoid((-score - F.lit(offset)) / F.lit(scaling))
    return F.lit(0.5) * (F.lit(1.0) + up - down)


PLY_BINS = ((40, "1-40"), (80, "41-80"), (120, "81-120"), (None, "121+"))


def ply_bin(ply: Column) -> Column:
    return F.when(ply <= 40, 0).when(ply <= 80, 1).when(ply <= 120, 2).otherwise(3)


def ply_bin_label(bin_: Column) -> Column:
    out = F.lit(PLY_BINS[-1][1])
    for i in (2, 1, 0):
        out = F.when(bin_ == i, PLY_BINS[i][1]).otherwise(out)
    return out
