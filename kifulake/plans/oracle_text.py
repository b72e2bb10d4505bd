"""Pieces of DuckDB text shared by several oracles."""

from __future__ import annotations

from ..functions import hashing as hs

_M64 = 1 << 64
_M32 = 1 << 32


def _mul(x: str, constant: int) -> str:
    lo, hi = constant % _M32, constant // _M32
    return (
        f"((((({x})::HUGEINT * {lo}) % {_M64}) + ((({x})::HUGEINT * {hi}) % {_M32}) * {_M32}) % {_M64})::UBIGINT"
    )


def draws(name: str, source: str, seed: int, epoch: str = "0", index: str = "rec_idx") -> str:
    """CTEs ending in ``name``: ``source`` plus the 24-bit draw ``u24``."""
    return f"""
  {name}_1 AS (SELECT *, xor(xor({_mul(index, hs.INDEX_MULTIPLIER)}, {seed}::UBIGINT), {_mul(epoch, hs.EPOCH_MULTIPLIER)}) AS hv FROM {source}),
  {name}_2 AS (SELECT * REPLACE (((hv::HUGEINT + {hs.GAMMA}) % {_M64})::UBIGINT AS hv) FROM {name}_1),
  {name}_3 AS (SELECT * REPLACE (xor(hv, hv >> 30) AS hv) FROM {name}_2),
  {name}_4 AS (SELECT * REPLACE ({_mul('hv', hs.MIX_1)} AS hv) FROM {name}_3),
  {name}_5 AS (SELECT * REPLACE (xor(hv, hv >> 27) AS hv) FROM {name}_4),
  {name}_6 AS (SELECT * REPLACE ({_mul('hv', hs.MIX_2)} AS hv) FROM {name}_5),
  {name} AS (SELECT * EXCLUDE (hv), CAST(xor(hv, hv >> 31) >> 40 AS BIGINT) AS u24 FROM {name}_6)"""


def games(name: str, source: str) -> str:
    """CTEs ending in ``name``: ``source`` plus ``game_seq``."""
    return f"""
  {name}_1 AS (SELECT *, CASE WHEN ply <= coalesce(lag(ply) OVER (PARTITION BY file_id ORDER BY rec_idx), 1000000)
                         THEN 1 ELSE 0 END AS g_start FROM {source}),
  {name} AS (SELECT * EXCLUDE (g_start), CAST(sum(g_start) OVER (ORDER BY file_id, rec_idx) - 1 AS BIGINT) AS game_seq
             FROM {name}_1)"""


def r(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


def sig(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def win_rate(s: str, offset: float, scaling: float) -> str:
    return f"(0.5 * (1.0 + {sig(f'(({s}) - {offset}) / {scaling}')} - {sig(f'(-({s}) - {offset}) / {scaling}')}))"
