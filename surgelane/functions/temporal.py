"""Calendar expressions on the pickup timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surgelane.config import DROPOFF_TS, FEATURES, PICKUP_TS, FeatureRules
from surgelane.functions.common import epoch_seconds, flag


def is_weekend(dow: Column) -> Column:
    """Spark day_of_week is 1=Sunday .. 7=Saturday."""
    return flag(dow.isin(1, 7))


def is_rush_hour(hour: Column, rules: FeatureRules = FEATURES) -> Column:
    (m0, m1), (e0, e1) = rules.morning_rush, rules.evening_rush
    return flag(hour.between(m0, m1 - 1) | hour.between(e0, e1 - 1))


def duration_minutes(pickup: str = PICKUP_TS, dropoff: str = DROPOFF_TS) -> Column:
    """Whole-second difference in minutes, rounded to 2 places."""
    return F.round((epoch_seconds(dropoff) - epoch_seconds(pickup)) / 60.0, 2)


def temporal_columns(
    pickup: str = PICKUP_TS, dropoff: str = DROPOFF_TS, rules: FeatureRules = FEATURES
) -> dict[str, Column]:
    p = F.col(pickup)
    return {
        "pickup_date": F.to_date(p),
        "hour": F.hour(p),
        "day_of_week": F.dayofweek(p),
        "day_of_month": F.dayofmonth(p),
        "month": F.month(p),
        "is_weekend": is_weekend(F.dayofweek(p)),
        "is_rush_hour": is_rush_hour(F.hour(p), rules),
        "trip_duration_minutes": duration_minutes(pickup, dropoff),
    }
