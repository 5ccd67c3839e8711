"""Regression metrics in one pass (A3-A7, M6) and top-k importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgelane.config import BOOST, SURGE_THRESHOLD
from surgelane.functions.loss import weighted_sq_error


def asymmetric_wmse(
    df: DataFrame, label: str, prediction: str, penalty: float = BOOST.underestimation_penalty
) -> DataFrame:
    return df.agg(F.avg(weighted_sq_error(F.col(label), F.col(prediction), penalty)).alias("asymmetric_wmse"))


def evaluate_predictions(
    df: DataFrame,
    label: str = "surge_multiplier",
    prediction: str = "prediction",
    threshold: float = SURGE_THRESHOLD,
    penalty: float = BOOST.underestimation_penalty,
) -> DataFrame:
    """One-row DataFrame: rmse, mae, r2_score, mape_percent,
    directional_accuracy_percent, under_estimation_rate_percent, asymmetric_wmse, n_rows.

    R² uses the population variance aggregate (numerically stable merge) for
    the total sum of squares; a constant label gives 1.0 for a perfect fit
    and 0.0 otherwise.
    """
    y, p = F.col(label), F.col(prediction)
    r = y - p
    surge_true = y >= threshold
    stats = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(r * r).alias("_ss_res"),
        (F.var_pop(y) * F.count(y)).alias("_ss_tot"),
        F.avg(F.abs(r)).alias("mae"),
        F.avg(F.when(y > 0, F.abs(r / y))).alias("_mape"),
        F.avg((surge_true == (p >= threshold)).cast("double")).alias("_dir"),
        F.avg(F.when(surge_true, (p < y).cast("double"))).alias("_under"),
        F.avg(weighted_sq_error(y, p, penalty)).alias("asymmetric_wmse"),
    )
    return stats.select(
        F.sqrt(F.col("_ss_res") / F.col("n_rows")).alias("rmse"),
        "mae",
        F.when(F.col("_ss_tot") > 0, F.lit(1.0) - F.col("_ss_res") / F.col("_ss_tot"))
        .when(F.col("_ss_res") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
        .alias("r2_score"),
        (F.col("_mape") * 100).alias("mape_percent"),
        (F.col("_dir") * 100).alias("directional_accuracy_percent"),
        F.coalesce(F.col("_under") * 100, F.lit(0.0)).alias("under_estimation_rate_percent"),
        "asymmetric_wmse",
        "n_rows",
    )


def top_k(df: DataFrame, k: int, by: str, tie: str, digits: int | None = None) -> DataFrame:
    """k largest ``by`` (ties broken by ``tie``), optionally rounded; adds rank."""
    spec = Window.orderBy(F.col(by).desc(), F.col(tie).asc())
    out = df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)
    out = out.withColumn("rank", F.row_number().over(spec))
    if digits is not None:
        out = out.withColumn(by, F.round(F.col(by), digits))
    return out
