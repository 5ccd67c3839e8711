"""Batch scoring of scenarios (B1-B6), re-aimed from a one-row dashboard.

Scenarios use the training conventions (day_of_week 1=Sunday..7=Saturday,
rush hours [7,10) and [16,20)), so scoring and training see the same feature
definitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgelane.config import FEATURES, SCORING, FeatureRules, ScoringRules
from surgelane.functions.common import flag
from surgelane.functions.temporal import is_rush_hour, is_weekend


def scenario_features(
    df: DataFrame, rules: ScoringRules = SCORING, calendar: FeatureRules = FEATURES
) -> DataFrame:
    """Derive demand_zscore (fixed population), weather_is_rain (precipitation
    above the threshold), is_weekend and is_rush_hour from scenario inputs."""
    cols = {}
    if "demand_60min" in df.columns:
        cols["demand_zscore"] = (F.col("demand_60min") - F.lit(rules.demand_mean)) / F.lit(rules.demand_sd)
    if "precipitation_in" in df.columns:
        cols["weather_is_rain"] = flag(F.col("precipitation_in") > rules.rain_precip)
    if "day_of_week" in df.columns:
        cols["is_weekend"] = is_weekend(F.col("day_of_week"))
    if "hour" in df.columns:
        cols["is_rush_hour"] = is_rush_hour(F.col("hour"), calendar)
    return df.withColumns(cols)


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's features in the model's order: absent ones are 0,
    NULLs are 0, extra columns are dropped (except ``keep``)."""
    present = set(df.columns)
    cols = [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0)).alias(c)
        for c in features
    ]
    return df.select(*[F.col(k) for k in keep], *cols)


def floor_prediction(pred: Column, rules: ScoringRules = SCORING) -> Column:
    """Floor at 1.0, no upper clamp."""
    return F.greatest(F.lit(rules.surge_floor), pred)


def surge_band(surge: Column, rules: ScoringRules = SCORING) -> Column:
    return (
        F.when(surge < rules.band_low, F.lit("Low"))
        .when(surge > rules.band_high, F.lit("High"))
        .otherwise(F.lit("Moderate"))
    )


def gauge_band(surge: Column, rules: ScoringRules = SCORING) -> Column:
    lo, mid, high, top = rules.gauge_edges
    return (
        F.when((surge >= lo) & (surge < mid), F.lit("green"))
        .when((surge >= mid) & (surge < high), F.lit("yellow"))
        .when((surge >= high) & (surge <= top), F.lit("red"))
    )


def add_bands(df: DataFrame, column: str, rules: ScoringRules = SCORING) -> DataFrame:
    s = F.col(column)
    return df.withColumns(
        {
            "surge_band": surge_band(s, rules),
            "gauge_band": gauge_band(s, rules),
            "surge_alert": flag(s >= rules.gauge_alert),
        }
    )


def score_scenarios(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    keep: Sequence[str] = (),
    rules: ScoringRules = SCORING,
) -> DataFrame:
    """scenario features -> aligned matrix -> predict -> floor -> bands.

    ``predict`` maps the aligned DataFrame to one with a ``prediction`` column
    (e.g. ``BoostedTrees.predict``).
    """
    aligned = align_features(scenario_features(df, rules), features, keep)
    scored = predict(aligned).withColumn("predicted_surge", floor_prediction(F.col("prediction"), rules))
    return add_bands(scored, "predicted_surge", rules)


def linear_surge(df: DataFrame) -> DataFrame:
    """Transparent stand-in scorer (checkable in SQL):
    0.5 + 0.4 demand_60min/supply_baseline + 0.1 is_rush_hour + 0.05 weather_is_rain."""
    pred = (
        F.lit(0.5)
        + F.lit(0.4) * F.col("demand_60min") / F.col("supply_baseline")
        + F.lit(0.1) * F.col("is_rush_hour")
        + F.lit(0.05) * F.col("weather_is_rain")
    )
    return df.withColumn("prediction", pred)


def yes_no(c: Column) -> Column:
    return F.when(c == 1, F.lit("Yes")).otherwise(F.lit("No"))


def two_decimals(c: Column) -> Column:
    """Fixed two-decimal text rounded on the exact binary value (as Python's
    '{:.2f}' does), without grouping separators."""
    return F.regexp_replace(F.format_number(c, 2), ",", "")


def scenario_report(scored: DataFrame) -> DataFrame:
    """Display columns of a scored scenario: surge as 'N.NNx', z-score with
    two decimals, rush/weekend/rain as Yes/No."""
    return scored.withColumns(
        {
            "surge_text": F.concat(two_decimals(F.col("predicted_surge")), F.lit("x")),
            "zscore_text": two_decimals(F.col("demand_zscore")),
            "rush_hour_text": yes_no(F.col("is_rush_hour")),
            "weekend_text": yes_no(F.col("is_weekend")),
            "raining_text": yes_no(F.col("weather_is_rain")),
        }
    )
