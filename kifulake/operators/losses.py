"""Loss functions over prediction tables: ``out, score, wdl, norm[, importance]``."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import sigmoid, win_rate


def sigmoid_mse(df: DataFrame, scale: float, blend: float) -> DataFrame:
    """Add ``sq_err`` and ``grad`` of the squared error between two sigmoids."""
    p = sigmoid(F.col("out") * scale)
    y = F.lit(blend) * F.col("wdl") + F.lit(1.0 - blend) * sigmoid(F.col("score") * F.lit(scale))
    df = df.withColumns({"_p": p, "_e": p - y})
    p, e = F.col("_p"), F.col("_e")
    grad = F.lit(2.0) * e * p * (F.lit(1.0) - p) * F.lit(scale) * F.col("norm")
    return df.withColumns({"sq_err": e * e, "grad": grad}).drop("_p", "_e")


@dataclass(frozen=True)
class WinRateLoss:
    """Parameters of the win-rate loss; ranges are checked before any data is read."""

    to_score: float = 600.0
    in_scaling: float = 340.0
    in_offset: float = 270.0
    target_scaling: float = 380.0
    target_offset: float = 270.0
    blend: float = 0.0
    power: float = 2.0
    asymmetry: float = 0.0
    boost_w1: float = 0.0
    boost_w2: float = 0.5

    def __post_init__(self) -> None:
        for name in ("to_score", "in_scaling", "target_scaling"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) > 0):
                raise ValueError(f"{name} must be finite and > 0")
        for name in ("asymmetry", "boost_w1", "boost_w2"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) >= 0):
                raise ValueError(f"{name} must be finite and >= 0")
        for name in ("in_offset", "target_offset"):
            if not math.isfinite(getattr(self, name)):
                raise ValueError(f"{name} must be finite")
        if not (math.isfinite(self.power) and self.power >= 1.0):
            raise ValueError("power must be finite and >= 1")
        if not 0.0 <= self.blend <= 1.0:
            raise ValueError("blend must be in [0, 1]")


def _with_error(df: DataFrame, k: WinRateLoss) -> DataFrame:
    """Add the score's win rate ``_pf``, the prediction's ``_qf``, ``_err`` and its slope."""
    net = F.col("out") * F.lit(k.to_score)
    up = sigmoid((net - F.lit(k.in_offset)) / F.lit(k.in_scaling))
    down = sigmoid((-net - F.lit(k.in_offset)) / F.lit(k.in_scaling))
    df = df.withColumns(
        {"_pf": win_rate(F.col("score"), k.target_offset, k.target_scaling), "_q": up, "_qm": down}
    )
    q, qm = F.col("_q"), F.col("_qm")
    df = df.withColumns(
        {
            "_qf": F.lit(0.5) * (F.lit(1.0) + q - qm),
            "_target": F.lit(k.blend) * F.col("wdl") + F.lit(1.0 - k.blend) * F.col("_pf"),
            "_slope": F.lit(k.to_score / k.in_scaling) * (q * (F.lit(1.0) - q) + qm * (F.lit(1.0) - qm)),
        }
    )
    return df.withColumn("_err", F.col("_qf") - F.col("_target"))


_WORK = ("_pf", "_q", "_qm", "_qf", "_target", "_slope", "_err")


def win_rate_loss(df: DataFrame, k: WinRateLoss) -> DataFrame:
    """Add ``sq_err`` and ``grad`` of the plain (quadratic, unweighted) win-rate loss."""
    df = _with_error(df, k)
    e = F.col("_err")
    return df.withColumns({"sq_err": e * e, "grad": e * F.col("_slope") * F.col("norm")}).drop(*_WORK)


def boost_weight(pf: Column, k: WinRateLoss) -> Column:
    centre = (pf - F.lit(0.5)) * (pf - F.lit(0.5)) * pf * (F.lit(1.0) - pf)
    return F.lit(1.0) + F.lit(2.0**k.boost_w1 - 1.0) * F.pow(centre, F.lit(k.boost_w2))


def general_loss_terms(df: DataFrame, k: WinRateLoss, importance: str | None = None) -> DataFrame:
    """Add ``loss_term`` (weighted), ``loss_weight`` and ``grad_term`` of the general loss.

    The loss is ``sum(loss_term) / sum(loss_weight)``; the gradient is
    ``grad_term / sum(loss_weight)``. Both sums come from one aggregate.
    """
    df = _with_error(df, k)
    weight = boost_weight(F.col("_pf"), k)
    if importance:
        weight = weight * F.col(importance)
    df = df.withColumns(
        {
            "_w": weight,
            "_asym": F.when(F.col("_qf") > F.col("_target"), F.lit(1.0 + k.asymmetry)).otherwise(F.lit(1.0)),
            "_abs": F.abs("_err"),
        }
    )
    signed = F.when(F.col("_err") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) * F.pow("_abs", F.lit(k.power - 1.0))
    return df.withColumns(
        {
            "loss_term": F.col("_asym") * F.pow("_abs", F.lit(k.power)) * F.col("_w"),
            "loss_weight": F.col("_w"),
            "grad_term": F.col("_w") * F.col("_asym") * F.lit(k.power) * signed * F.lit(0.5) * F.col("_slope"),
        }
    ).drop(*_WORK, "_w", "_asym", "_abs")


def general_loss(df: DataFrame, k: WinRateLoss, importance: str | None = None, by: list[str] | None = None) -> DataFrame:
    """One row (per group) with ``n, sum_weight, mean_loss, grad_l1``."""
    terms = general_loss_terms(df, k, importance)
    sums = terms.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("loss_weight").alias("sum_weight"),
        F.sum("loss_term").alias("_loss"),
        F.sum(F.abs("grad_term")).alias("_grad"),
    )
    return sums.select(
        *(by or []), "n", "sum_weight",
        (F.col("_loss") / F.col("sum_weight")).alias("mean_loss"),
        (F.col("_grad") / F.col("sum_weight")).alias("grad_l1"),
    )


def ablation_delta(features: DataFrame, targets: DataFrame, specs: dict[str, Column]) -> DataFrame:
    """Loss with a feature subset zeroed minus loss with all weights, per subset.

    ``features`` has ``pos_id, w`` and whatever the spec predicates read. All subsets are
    scored in the same aggregation: features are read once, whatever the number of specs.
    """
    sums = [F.sum("w").alias("_z_all")]
    sums += [F.sum(F.when(pred, 0.0).otherwise(F.col("w"))).alias(f"_z_{i}") for i, pred in enumerate(specs.values())]
    z = features.groupBy("pos_id").agg(*sums).join(targets, "pos_id")

    def loss(col: str) -> Column:
        e = sigmoid(F.col(col)) - F.col("target")
        return F.avg(e * e)

    means = z.agg(loss("_z_all").alias("base_loss"), *[loss(f"_z_{i}").alias(f"_l_{i}") for i in range(len(specs))])
    rows = F.array(*[F.struct(F.lit(n).alias("spec"), F.col(f"_l_{i}").alias("loss")) for i, n in enumerate(specs)])
    return means.select("base_loss", F.explode(rows).alias("e")).select(
        "e.spec", "e.loss", (F.col("e.loss") - F.col("base_loss")).alias("delta")
    )
