"""Flagship report: surge by pickup borough and hour.

trips -> quality -> temporal -> collapsed (location, second) surge profile ->
zone lookup (checked broadcast) -> GROUP BY (borough, hour).

Every aggregate is computed from the collapsed rows weighted by their trip
count, so trip rows are scanned once, pre-aggregated map-side and never
shuffled individually.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgelane.config import FEATURES, PU_LOC, QUALITY, SURGE_THRESHOLD, FeatureRules, QualityRules
from surgelane.functions.common import round_half_up
from surgelane.operators.demand import TRIPS_AT_SECOND, demand_col
from surgelane.operators.dimensions import join_dimension
from surgelane.operators.quality import apply_quality_filters
from surgelane.operators.supply import surge_profile
from surgelane.operators.temporal import extract_temporal_features


def clean_trips(trips: DataFrame, quality: QualityRules = QUALITY, rules: FeatureRules = FEATURES) -> DataFrame:
    return extract_temporal_features(apply_quality_filters(trips, quality), rules, quality)


def surge_by_borough_hour(
    trips: DataFrame,
    zones: DataFrame,
    quality: QualityRules = QUALITY,
    rules: FeatureRules = FEATURES,
) -> DataFrame:
    prof = surge_profile(clean_trips(trips, quality, rules), rules)
    boroughs = zones.select(F.col("LocationID").alias("_zone_id"), F.col("Borough").alias("_borough"))
    enriched = join_dimension(prof, boroughs, left_on=[PU_LOC], right_on=["_zone_id"])
    n = F.col(TRIPS_AT_SECOND)
    surge = F.col("surge_multiplier")
    return (
        enriched.groupBy(F.coalesce(F.col("_borough"), F.lit("Unknown")).alias("borough"), "hour")
        .agg(
            F.sum(n).alias("trips"),
            (F.sum(n * surge) / F.sum(n)).alias("_avg_surge"),
            F.max(demand_col(60)).alias("max_demand_60"),
            F.max(surge).alias("_max_surge"),
            F.sum(n * F.col("demand_zscore")).alias("_sum_z"),
            F.sum(F.when(surge >= SURGE_THRESHOLD, n).otherwise(0)).alias("surged_trips"),
        )
        .select(
            "borough",
            "hour",
            "trips",
            round_half_up(F.col("_avg_surge"), 6).alias("avg_surge"),
            "max_demand_60",
            round_half_up(F.col("_max_surge"), 6).alias("max_surge"),
            round_half_up(F.col("_sum_z"), 4).alias("sum_zscore"),
            "surged_trips",
        )
    )


# A zone and hour is saturated if at least this share of its trips meets a surge.
SATURATED_SHARE = 0.5


def saturation_zones(
    trips: DataFrame,
    zones: DataFrame,
    quality: QualityRules = QUALITY,
    rules: FeatureRules = FEATURES,
) -> DataFrame:
    """Pickup zones by hour: trips, share of them at a surge, and whether that saturates the zone.

    From the collapsed rows, like the flagship report.
    """
    prof = surge_profile(clean_trips(trips, quality, rules), rules)
    names = zones.select(F.col("LocationID").alias("_zone_id"), F.col("Borough").alias("borough"), F.col("Zone").alias("zone"))
    n = F.col(TRIPS_AT_SECOND)
    share = F.col("surged") / F.col("trips")
    by_zone = prof.groupBy(PU_LOC, "hour").agg(
        F.sum(n).alias("trips"), F.sum(F.when(F.col("surge_multiplier") >= SURGE_THRESHOLD, n).otherwise(0)).alias("surged")
    )
    return join_dimension(by_zone, names, left_on=[PU_LOC], right_on=["_zone_id"]).select(
        PU_LOC, "borough", "zone", "hour", "trips", share.alias("surged_share"), (share >= SATURATED_SHARE).alias("saturated")
    )
