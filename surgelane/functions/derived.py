"""Per-trip derived features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surgelane.config import FEATURES, FeatureRules
from surgelane.functions.common import flag, safe_div


def derived_columns(rules: FeatureRules = FEATURES) -> dict[str, Column]:
    dist = F.col("trip_distance")
    fare = F.col("fare_amount")
    dur = F.col("trip_duration_minutes")
    d15, d30, d60 = F.col("demand_15min"), F.col("demand_30min"), F.col("demand_60min")
    speed = safe_div(dist, dur / 60, guard=dur > 0)
    return {
        "fare_per_mile": safe_div(fare, dist),
        "fare_per_minute": safe_div(fare, dur),
        # The congestion flag reads the uncapped speed; the cap cannot change it.
        "speed_mph": F.least(speed, F.lit(rules.speed_cap)),
        "demand_acceleration": safe_div(d15, d60),
        "demand_trend": d30 - d60,
        "congestion_indicator": flag((speed > 0) & (speed < rules.congestion_speed)),
    }
