"""Semantic constants and column contracts."""

from __future__ import annotations

from surgelane.config import (
    BOOST,
    FEATURE_TABLE_COLUMNS,
    FEATURES,
    MODEL_FEATURES,
    PARTITION_KEYS,
    QUALITY,
    RAW_COLUMNS,
    SCORING,
    WEATHER_DEFAULTS,
)


def test_quality_bounds():
    assert (QUALITY.min_distance, QUALITY.max_distance) == (0.1, 200.0)
    assert (QUALITY.min_fare, QUALITY.max_fare) == (1.0, 5000.0)
    assert (QUALITY.min_passengers, QUALITY.max_passengers) == (1, 9)
    assert QUALITY.year == 2024 and (QUALITY.min_duration, QUALITY.max_duration) == (0.5, 360.0)


def test_feature_rules():
    assert FEATURES.rolling_minutes == (15, 30, 60)
    assert (FEATURES.min_surge, FEATURES.max_surge) == (1.0, 5.0)
    assert FEATURES.morning_rush == (7, 10) and FEATURES.evening_rush == (16, 20)
    assert FEATURES.speed_cap == 100.0 and FEATURES.supply_lookback_days == 28
    assert WEATHER_DEFAULTS == {"temperature_f": 55.0, "precipitation_in": 0.0, "wind_speed_mph": 8.0,
                                "visibility_miles": 10.0}


def test_model_params():
    assert (BOOST.max_depth, BOOST.learning_rate, BOOST.n_rounds) == (8, 0.05, 500)
    assert (BOOST.subsample, BOOST.colsample, BOOST.reg_alpha, BOOST.reg_lambda) == (0.8, 0.8, 0.1, 1.0)
    assert (BOOST.min_child_weight, BOOST.gamma, BOOST.early_stopping_rounds) == (5.0, 0.1, 50)
    assert BOOST.underestimation_penalty == 2.0 and BOOST.validation_fraction == 0.2 and BOOST.seed == 42
    assert BOOST.rounds_per_batch == 10


def test_contracts():
    assert len(RAW_COLUMNS) == 17 and len(FEATURE_TABLE_COLUMNS) == 36 and len(MODEL_FEATURES) == 32
    assert set(MODEL_FEATURES) < set(FEATURE_TABLE_COLUMNS)
    assert set(FEATURE_TABLE_COLUMNS) - set(MODEL_FEATURES) == {
        "h3_pickup_index", "h3_dropoff_index", "pickup_date", "surge_multiplier"}
    assert PARTITION_KEYS == ("pickup_date", "hour")
    assert (SCORING.demand_mean, SCORING.demand_sd, SCORING.band_low, SCORING.band_high) == (120.0, 40.0, 1.2, 2.0)
