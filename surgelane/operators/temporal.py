"""Temporal features (C1) followed by the duration filter."""

from __future__ import annotations

from pyspark.sql import DataFrame

from surgelane.config import DROPOFF_TS, FEATURES, PICKUP_TS, QUALITY, FeatureRules, QualityRules
from surgelane.functions.temporal import temporal_columns
from surgelane.operators.quality import duration_filter


def extract_temporal_features(
    df: DataFrame,
    rules: FeatureRules = FEATURES,
    quality: QualityRules = QUALITY,
    pickup: str = PICKUP_TS,
    dropoff: str = DROPOFF_TS,
) -> DataFrame:
    """pickup_date, hour, day_of_week (1=Sun), day_of_month, month, is_weekend,
    is_rush_hour, trip_duration_minutes; then drop implausible durations.

    All columns land in one Project (no chained withColumn).
    """
    return duration_filter(df.withColumns(temporal_columns(pickup, dropoff, rules)), quality)
