"""Derived trip features in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from surgelane.config import FEATURES, FeatureRules
from surgelane.functions.derived import derived_columns


def add_derived_features(df: DataFrame, rules: FeatureRules = FEATURES) -> DataFrame:
    """fare_per_mile, fare_per_minute, speed_mph (capped), demand_acceleration,
    demand_trend, congestion_indicator — zero where a denominator is not positive."""
    return df.withColumns(derived_columns(rules))
