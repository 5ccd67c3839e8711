"""Data-quality filter (F1-F6) and the duration filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surgelane.config import DROPOFF_TS, PICKUP_TS, QUALITY, QualityRules
from surgelane.functions.common import ts_literal


def quality_condition(df: DataFrame, rules: QualityRules = QUALITY):
    """One conjunctive predicate; every comparison is Parquet-pushable.

    The pickup-year rule is written as a half-open timestamp range (a
    ``year(ts) = Y`` predicate cannot be pushed to the scan).
    """
    y = rules.year
    pax = F.col("passenger_count")
    return (
        F.col(PICKUP_TS).isNotNull()
        & F.col(DROPOFF_TS).isNotNull()
        & (F.col(PICKUP_TS) >= ts_literal(df, PICKUP_TS, f"{y}-01-01 00:00:00"))
        & (F.col(PICKUP_TS) < ts_literal(df, PICKUP_TS, f"{y + 1}-01-01 00:00:00"))
        & F.col("trip_distance").between(rules.min_distance, rules.max_distance)
        & F.col("fare_amount").between(rules.min_fare, rules.max_fare)
        & (pax.isNull() | pax.between(rules.min_passengers, rules.max_passengers))
        & (F.col("total_amount") > 0)
    )


def rule_violations(df: DataFrame, rules: QualityRules = QUALITY) -> dict[str, Column]:
    """Per rule, whether a raw row breaks it; a row may break several."""
    year = [ts_literal(df, PICKUP_TS, f"{y}-01-01 00:00:00") for y in (rules.year, rules.year + 1)]
    pickup, pax = F.col(PICKUP_TS), F.col("passenger_count")
    unless = lambda kept: ~F.coalesce(kept, F.lit(False))
    return {
        "null_pickup": pickup.isNull(),
        "null_dropoff": F.col(DROPOFF_TS).isNull(),
        "other_year": unless((pickup >= year[0]) & (pickup < year[1])),
        "bad_distance": unless(F.col("trip_distance").between(rules.min_distance, rules.max_distance)),
        "bad_fare": unless(F.col("fare_amount").between(rules.min_fare, rules.max_fare)),
        "bad_passengers": unless(pax.isNull() | pax.between(rules.min_passengers, rules.max_passengers)),
        "bad_total": unless(F.col("total_amount") > 0),
    }


def apply_quality_filters(df: DataFrame, rules: QualityRules = QUALITY) -> DataFrame:
    """Keep plausible trips: 2024 pickups, bounded distance/fare/passengers, total > 0.

    NULL passenger_count is kept; any other NULL in a tested column drops the row.
    """
    return df.filter(quality_condition(df, rules))


def duration_filter(df: DataFrame, rules: QualityRules = QUALITY) -> DataFrame:
    """Strictly between the bounds, on the rounded duration."""
    d = F.col("trip_duration_minutes")
    return df.filter((d > rules.min_duration) & (d < rules.max_duration))


def contract_report(df: DataFrame) -> DataFrame:
    """One-row data-contract check of processed trips in a single aggregation:
    bounds, pickup-year range, hour range and 0/1 flags (the invariants the
    filters and calendar features promise)."""
    flags = ("is_weekend", "is_rush_hour")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("trip_distance").alias("min_trip_distance"),
        F.max("trip_distance").alias("max_trip_distance"),
        F.min("fare_amount").alias("min_fare_amount"),
        F.max("fare_amount").alias("max_fare_amount"),
        F.min("total_amount").alias("min_total_amount"),
        F.min(F.year(PICKUP_TS)).alias("min_pickup_year"),
        F.max(F.year(PICKUP_TS)).alias("max_pickup_year"),
        F.min("hour").alias("min_hour"),
        F.max("hour").alias("max_hour"),
        F.min("trip_duration_minutes").alias("min_duration"),
        F.max("trip_duration_minutes").alias("max_duration"),
        F.sum(
            sum((~F.col(c).isin(0, 1)).cast("int") for c in flags)
        ).alias("bad_flags"),
        F.sum(F.col("passenger_count").isNull().cast("int")).alias("null_passengers"),
    )
