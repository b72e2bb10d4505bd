"""Schedules as column expressions over a superbatch number (and a batch number).

Each function returns ``schedule(superbatch, batch) -> Column``; wrappers take schedules.
Superbatches count from 1, batches from 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Schedule = Callable[[Column, Column], Column]


def _d(x) -> Column:
    return F.lit(float(x))


def constant(value: float) -> Schedule:
    return lambda sb, batch: _d(value)


def drop(start: float, gamma: float, at: int) -> Schedule:
    return lambda sb, batch: F.when(sb > at, _d(start * gamma)).otherwise(_d(start))


def step(start: float, gamma: float, every: int) -> Schedule:
    def f(sb, batch):
        n = F.floor(F.greatest(sb - 1, F.lit(0)) / F.lit(every))
        return _d(start) * F.pow(_d(gamma), n.cast("double"))

    return f


def _until(final_superbatch: int, final: float, body: Callable[[Column], Column]) -> Schedule:
    def f(sb, batch):
        fraction = sb.cast("double") / _d(final_superbatch)
        return F.when(sb >= final_superbatch, _d(final)).otherwise(body(fraction))

    return f


def linear(initial: float, final: float, final_superbatch: int) -> Schedule:
    return _until(final_superbatch, final, lambda x: _d(initial) + x * _d(final - initial))


def cosine(initial: float, final: float, final_superbatch: int) -> Schedule:
    def body(x):
        weight = _d(1.0) - _d(0.5) * (_d(1.0) + F.cos(_d(math.pi) * x))
        return _d(initial) + weight * _d(final - initial)

    return _until(final_superbatch, final, body)


def exponential(initial: float, final: float, final_superbatch: int) -> Schedule:
    return _until(final_superbatch, final, lambda x: _d(initial) * F.pow(_d(final / initial), x))


def one_cycle(
    peak: float, warmup_fraction: float, div_factor: float, final_div_factor: float, total: int
) -> Schedule:
    initial = peak / div_factor
    final = initial / final_div_factor
    warm = min(max(math.floor(warmup_fraction * total + 0.5), 0), total)

    def blend(start, end, p):
        return _d(end) + _d(0.5 * (start - end)) * (_d(1.0) + F.cos(_d(math.pi) * p))

    def f(sb, batch):
        x = sb.cast("double")
        rise = blend(initial, peak, x / _d(max(warm, 1)))
        fall = blend(peak, final, (x - _d(warm)) / _d(max(total - warm, 1)))
        return F.when(sb <= warm, rise).when(sb >= total, _d(final)).otherwise(fall)

    return f


def with_warmup(inner: Schedule, batches: int) -> Schedule:
    def f(sb, batch):
        base = inner(sb, batch)
        left = F.lit(batches) - batch
        return F.when((sb == 1) & (batch < batches), base / left.cast("double")).otherwise(base)

    return f


def in_sequence(first: Schedule, second: Schedule, switch_after: int) -> Schedule:
    def f(sb, batch):
        return F.when(sb <= switch_after, first(sb, batch)).otherwise(
            second(sb - F.lit(switch_after), batch)
        )

    return f


def linear_blend(start: float, end: float, last_superbatch: int) -> Schedule:
    """Linear taper of the target blend from ``start`` at 1 to ``end`` at the last superbatch."""
    slope = (end - start) / max(last_superbatch - 1, 1)
    return lambda sb, batch: _d(start) + _d(slope) * (sb - 1).cast("double")
