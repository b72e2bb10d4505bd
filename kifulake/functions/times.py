"""Time texts of run documents and logs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(epoch_seconds: Column) -> Column:
    """Wall clock of a second count in UTC, whatever the session's zone."""
    return F.timestamp_add("SECOND", epoch_seconds, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))


def utc_iso(epoch_seconds: Column) -> Column:
    """``2024-01-30T23:59:25Z``."""
    return F.date_format(_at(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_compact(epoch_seconds: Column) -> Column:
    """``20240130t235925z``."""
    return F.date_format(_at(epoch_seconds), "yyyyMMdd't'HHmmss'z'")


def duration(seconds: Column) -> Column:
    """``1h23m45s``, ``12m05s`` or ``42s``; ``??`` for a negative, infinite or missing number."""
    usable = F.coalesce((seconds >= 0) & ~F.isnan(seconds) & (seconds < F.lit(float("inf"))), F.lit(False))
    whole = F.when(usable, F.floor(seconds)).cast("bigint")
    h, m, s = (F.call_function("div", whole, F.lit(3600)), F.call_function("div", whole % 3600, F.lit(60)), whole % 60)
    return (
        F.when(~usable, "??")
        .when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s))
        .when(m > 0, F.format_string("%dm%02ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )
