"""Square arithmetic: a square is ``file * 9 + rank``, 81 means "none"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLACK, WHITE = 0, 1
NONE_SQUARE = 81


def file_of(sq: Column) -> Column:
    return F.floor(sq / F.lit(9)).cast("int")


def rank_of(sq: Column) -> Column:
    return (sq % F.lit(9)).cast("int")


def inverse(sq: Column) -> Column:
    return (F.lit(80) - sq).cast("int")


def mirror_file(sq: Column) -> Column:
    return ((F.lit(8) - file_of(sq)) * F.lit(9) + rank_of(sq)).cast("int")


def viewed_by(sq: Column, perspective: Column, mirrored: Column | None = None) -> Column:
    """``sq`` as the perspective's player sees it, then file-mirrored where asked."""
    seen = F.when(perspective == BLACK, sq.cast("int")).otherwise(inverse(sq))
    if mirrored is None:
        return seen
    return F.when(mirrored, mirror_file(seen)).otherwise(seen)
