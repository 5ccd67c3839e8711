"""Hourly calendar spine (C12) and the weather join
(J4 with the one-hot P5 and default fill P4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelane.config import PICKUP_TS, WEATHER_CONDITIONS, WEATHER_DEFAULTS
from surgelane.functions.common import flag
from surgelane.functions.weather import classify_condition
from surgelane.operators.dimensions import join_dimension
from surgelane.sources.files import WEATHER_COLUMNS



def _spine_columns(hour_ts):
    return [
        hour_ts.alias("hour_ts"),
        F.to_date(hour_ts).alias("date"),
        F.hour(hour_ts).alias("hour"),
        F.dayofyear(hour_ts).alias("day_of_year"),
    ]


def hour_spine(df: DataFrame, ts: str = PICKUP_TS) -> DataFrame:
    """One row per clock hour from the first to the last hour present in ``ts``.

    A global min/max (partial aggregates) then one generator; the output grows
    with the time span (24 rows per day), not with the row count.
    """
    bounds = df.agg(
        F.date_trunc("hour", F.min(ts)).cast("timestamp_ntz").alias("lo"),
        F.date_trunc("hour", F.max(ts)).cast("timestamp_ntz").alias("hi"),
    )
    hours = bounds.select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour_ts")
    )
    return hours.select(*_spine_columns(F.col("hour_ts")))


def year_spine(spark: SparkSession, year: int) -> DataFrame:
    """Every hour of a calendar year (8,784 rows for a leap year)."""
    lo = F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{year}-12-31 23:00:00").cast("timestamp_ntz")
    hours = spark.range(1).select(
        F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR"))).alias("hour_ts")
    )
    return hours.select(*_spine_columns(F.col("hour_ts")))


def classify_weather(weather: DataFrame) -> DataFrame:
    return weather.withColumn(
        "weather_condition",
        classify_condition(
            F.col("precipitation_in"), F.col("temperature_f"), F.col("visibility_miles")
        ),
    )


def weather_onehot(df: DataFrame, column: str = "weather_condition") -> DataFrame:
    """weather_is_<c> for the fixed categories; NULL condition gives all zeros."""
    return df.withColumns(
        {f"weather_is_{c.lower()}": flag(F.col(column) == c) for c in WEATHER_CONDITIONS}
    )


def integrate_weather(
    trips: DataFrame,
    weather: DataFrame,
    date_col: str = "pickup_date",
    hour_col: str = "hour",
) -> DataFrame:
    """Left join hourly weather on (pickup_date = date, hour = hour), one-hot the
    condition, then fill hours without weather with the defaults.

    The weather table is a dimension keyed by (date, hour), unique in the plan;
    Spark broadcasts it by its own threshold. ``date`` is cast to DATE so a
    timestamp-typed weather file still joins.
    """
    dim = weather.select(
        F.col("date").cast("date").alias("_w_date"),
        F.col("hour").cast("int").alias("_w_hour"),
        *[F.col(c) for c in WEATHER_COLUMNS if c not in ("date", "hour")],
    )
    joined = join_dimension(trips, dim, left_on=[date_col, hour_col], right_on=["_w_date", "_w_hour"])
    return weather_onehot(joined).fillna(WEATHER_DEFAULTS)
