"""Batch scoring of positions with a quantised layered net held in tensor tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import with_edge_ids
from .features import FEATURE_SETS, with_half_ids

# Quantisation of activations and weights, and the skip output of layer one.
QA, QB, SKIP = 127, 64, 1


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    """Single-precision product rounded half away from zero."""
    y = np.asarray(x, np.float32) * np.float32(scale)
    return (np.sign(y) * np.floor(np.abs(y) + np.float32(0.5))).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in 16 bits; one that does not fit is an error."""
    if len(x) and (x.min() < -(1 << 15) or x.max() >= 1 << 15):
        raise ValueError("a feature weight does not fit 16 bits")
    return x.astype(np.int16)


@dataclass(frozen=True)
class Net:
    """Integer tensors: ``ft`` (features, width), then per bucket ``(out, in)`` and biases."""

    ft: np.ndarray
    ft_b: np.ndarray
    l1: np.ndarray
    l1_b: np.ndarray
    l2: np.ndarray
    l2_b: np.ndarray
    l3: np.ndarray
    l3_b: np.ndarray

    @classmethod
    def from_tensors(cls, t: dict[str, np.ndarray], width: int, buckets: int) -> Net:
        """From flat float tensors named ``ft_w, ft_b, l1_w, …`` in row-major order."""
        per = lambda name: quantise(t[name], QA * QB).reshape(buckets, -1)
        l1_b, l2_b, l3_b = per("l1_b"), per("l2_b"), per("l3_b")
        l1_out, l2_out = l1_b.shape[1], l2_b.shape[1]
        return cls(
            _narrow(quantise(t["ft_w"], QA)).reshape(-1, width), quantise(t["ft_b"], QA),
            quantise(t["l1_w"], QB).reshape(buckets, l1_out, width), l1_b,
            quantise(t["l2_w"], QB).reshape(buckets, l2_out, 2 * (l1_out - SKIP)), l2_b,
            quantise(t["l3_w"], QB).reshape(buckets, l2_out), l3_b[:, 0],
        )

    @classmethod
    def from_table(cls, tensors: DataFrame, width: int, buckets: int, max_values: int) -> Net:
        """From a ``(name, idx, v)`` table of at most ``max_values`` rows, a bound set by the net."""
        rows = tensors.select("name", "idx", "v").limit(max_values + 1).toArrow()
        if rows.num_rows > max_values:
            raise ValueError(f"the net has more than {max_values} values")
        names = np.asarray(rows["name"].to_pylist())
        idx, v = np.asarray(rows["idx"]), np.asarray(rows["v"])
        flat = {}
        for name in np.unique(names):
            mine = names == name
            flat[str(name)] = v[mine][np.argsort(idx[mine])]
        return cls.from_tensors(flat, width, buckets)


def _pairwise(acc: np.ndarray) -> np.ndarray:
    x = np.clip(acc, 0, QA)
    half = x.shape[1] // 2
    return np.clip((x[:, :half] * x[:, half:]) >> 7, 0, 126)


def _sum_rows(net: Net, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the feature rows of each position (``offsets`` delimit its ids)."""
    out = np.zeros((len(offsets) - 1, net.ft.shape[1]), np.int64)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.add.reduceat(net.ft[ids], offsets[filled], axis=0, dtype=np.int64)
    return out + net.ft_b


def forward(net: Net, stm: np.ndarray, nstm: np.ndarray, offsets: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Raw integer output of every position of a batch."""
    x = np.hstack([_pairwise(_sum_rows(net, stm, offsets)), _pairwise(_sum_rows(net, nstm, offsets))])
    one = np.einsum("ni,noi->no", x, net.l1[bucket]) + net.l1_b[bucket]
    main, skip = one[:, :-SKIP], one[:, -1]
    two_in = np.hstack([np.clip((main * main) >> 19, 0, 127), np.clip(main >> 6, 0, 127)])
    two = np.einsum("ni,noi->no", two_in, net.l2[bucket]) + net.l2_b[bucket]
    act = np.clip(two >> 6, 0, 127)
    return np.einsum("ni,ni->n", act, net.l3[bucket]) + net.l3_b[bucket] + skip


def batch_score_positions(positions: DataFrame, net: Net, feature_set: str, fv_scale: int, profile: str | None = None) -> DataFrame:
    """``(pos_id, raw, cp)``: the net's raw output and ``raw / fv_scale`` for every position.

    ``positions`` has ``bucket``. A position's ids are arrays of its own row, at most 40 of the feature set
    (with or without kings) and the edges of ``profile`` behind them, scored in Arrow batches against the
    broadcast net, whose feature table is held in 16 bits.
    """
    rows = positions
    if profile:
        rows = with_edge_ids(rows, profile, FEATURE_SETS[feature_set].ft_in, "_es", "_en")
    rows = with_half_ids(rows, feature_set, "s", "n")
    ids = [F.concat(c, e).alias(c) if profile else F.col(c) for c, e in (("s", "_es"), ("n", "_en"))]
    rows = rows.select("pos_id", "bucket", *ids)
    shared = positions.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023,E731
            stm, nstm = col("s"), col("n")
            offsets = np.asarray(stm.offsets)
            raw = forward(shared.value, np.asarray(stm.flatten()), np.asarray(nstm.flatten()), offsets - offsets[0], np.asarray(col("bucket")))
            yield pa.RecordBatch.from_pydict({"pos_id": col("pos_id"), "raw": pa.array(raw)})

    scored = rows.mapInArrow(run, "pos_id bigint, raw bigint")
    return scored.withColumn("cp", F.col("raw") / F.lit(float(fv_scale)))
