"""Phase B: processed trips -> spatial -> demand/supply/surge -> weather ->
derived -> 36-column feature table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelane.config import FEATURE_TABLE_COLUMNS, FEATURES, FeatureRules
from surgelane.operators.demand import demand_profile
from surgelane.operators.derived import add_derived_features
from surgelane.operators.spatial import add_spatial_index
from surgelane.operators.supply import SUPPLY_KEYS, baseline_state, supply_from_profile, supply_from_state, surge_features
from surgelane.operators.weather import integrate_weather
from surgelane.session import list_folders, materialise
from surgelane.sinks.tables import write_feature_table
from surgelane.sources.files import read_partitioned, require_not_empty, tolerant_select


def feature_transform(
    processed: DataFrame,
    weather: DataFrame,
    rules: FeatureRules = FEATURES,
    spatial: str = "auto",
    lookback_days: int | None = None,
    since: str | None = None,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """All feature columns on every trip (the trip table is shuffled once, for
    the (location, second) join that brings back demand and surge). Trips before
    ``since`` are rolling-window context only; ``baseline`` is then the whole
    input's supply table."""
    df = add_spatial_index(processed, spatial)
    df = surge_features(df, rules, lookback_days=lookback_days, since=since, baseline=baseline)
    df = integrate_weather(df, weather)
    return add_derived_features(df, rules)


def feature_table(processed: DataFrame, weather: DataFrame, **kw) -> DataFrame:
    return tolerant_select(feature_transform(processed, weather, **kw), FEATURE_TABLE_COLUMNS)


def baseline_table(processed: DataFrame, rules: FeatureRules = FEATURES) -> DataFrame:
    """Supply baseline of the whole input, one row per (location, hour, weekday)."""
    return supply_from_profile(demand_profile(processed, rules, carry=list(SUPPLY_KEYS[1:])))


def write_baseline_state(
    spark: SparkSession,
    processed_path: str,
    state_path: str,
    date_from: str | None = None,
    date_to: str | None = None,
    rules: FeatureRules = FEATURES,
) -> str:
    """Baseline sums per key and date, one folder a date, of all dates or of [date_from, date_to + 1].

    The day after a range is redone too, since the trips of a day's last hour
    count in the demand of the next day's first. Only those dates, and the day
    before as context, are read; other dates of the state stay. A date that has
    lost its trips is left with a row that counts none.
    """
    day = dt.timedelta(days=1)
    first = dt.date.fromisoformat(date_from) if date_from else None
    last = dt.date.fromisoformat(date_to) + day if date_to else None
    processed = read_partitioned(spark, processed_path, (first - day).isoformat() if first else None, last.isoformat() if last else None)
    prof = demand_profile(processed, rules, carry=[*SUPPLY_KEYS[1:], "pickup_date"])
    state = baseline_state(prof)
    if first:
        state = state.where(F.col("pickup_date") >= F.lit(first))
    if first and last:
        days = [(first + i * day,) for i in range((last - first).days + 1)]
        empty = spark.createDataFrame(days, "pickup_date date").select(
            *[F.lit(None).cast(state.schema[k].dataType).alias(k) for k in SUPPLY_KEYS], "pickup_date",
            *[F.lit(0).cast(state.schema[c].dataType).alias(c) for c in ("_n", "_sx", "_sxx")],
        )
        state = state.unionByName(empty)
    writer = state.hint("rebalance", "pickup_date").write.mode("overwrite").partitionBy("pickup_date")
    if first or last:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(state_path)
    return state_path


def run_features(
    spark: SparkSession,
    processed_path: str,
    weather: DataFrame,
    out_path: str,
    date_from: str | None = None,
    date_to: str | None = None,
    baseline_path: str | None = None,
) -> str:
    """Feature table of all trips, or of those picked up in [date_from, date_to] (inclusive).

    A range gives the same values as a full run and replaces those dates only:
    partition pruning reads them plus the day before, whose trips complete the
    rolling windows and are then dropped. The supply baseline comes from the state
    in ``baseline_path`` (``write_baseline_state``), of which the range's dates are
    brought up to date first, so no other trips are read; the first run, and each
    full run, writes the state whole. Without a path the whole processed table is
    read for the baseline.
    """
    if not (date_from or date_to):
        processed = require_not_empty(read_partitioned(spark, processed_path), processed_path)
        if baseline_path:
            write_baseline_state(spark, processed_path, baseline_path)
        return write_feature_table(feature_transform(processed, weather), out_path)
    if baseline_path:
        known = bool(list_folders(spark, baseline_path))
        write_baseline_state(spark, processed_path, baseline_path, *((date_from, date_to) if known else ()))
        baseline = materialise(supply_from_state(spark.read.parquet(baseline_path)), "supply_baseline")
    else:
        baseline = materialise(baseline_table(read_partitioned(spark, processed_path)), "supply_baseline")
    read_from = (dt.date.fromisoformat(date_from) - dt.timedelta(days=1)).isoformat() if date_from else None
    processed = require_not_empty(read_partitioned(spark, processed_path, read_from, date_to), processed_path)
    ranged = feature_transform(processed, weather, since=date_from or "0001-01-01", baseline=baseline)
    return write_feature_table(ranged, out_path, only_touched=True)
