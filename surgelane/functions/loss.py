"""Asymmetric squared loss: under-estimation (y > p) weighs ``penalty`` times more (M3, A3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surgelane.config import BOOST


def residual(y: Column, p: Column) -> Column:
    return y - p


def loss_weight(r: Column, penalty: float = BOOST.underestimation_penalty) -> Column:
    return F.when(r > 0, F.lit(float(penalty))).otherwise(F.lit(1.0))


def gradient(y: Column, p: Column, penalty: float = BOOST.underestimation_penalty) -> Column:
    r = residual(y, p)
    return F.when(r > 0, F.lit(-2.0 * penalty) * r).otherwise(F.lit(-2.0) * r)


def hessian(y: Column, p: Column, penalty: float = BOOST.underestimation_penalty) -> Column:
    r = residual(y, p)
    return F.when(r > 0, F.lit(2.0 * penalty)).otherwise(F.lit(2.0))


def weighted_sq_error(y: Column, p: Column, penalty: float = BOOST.underestimation_penalty) -> Column:
    """Per-row term of the asymmetric weighted MSE."""
    r = residual(y, p)
    return loss_weight(r, penalty) * r * r
