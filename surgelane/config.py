"""Column contracts and thresholds (frozen, so a job cannot mutate them)."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Column names and semantics constants that must equal the
# reference pipeline for results to match.
# ---------------------------------------------------------------------------

PICKUP_TS = "tpep_pickup_datetime"
DROPOFF_TS = "tpep_dropoff_datetime"
PU_LOC = "PULocationID"
DO_LOC = "DOLocationID"

# Raw keep-list, declared order.
RAW_COLUMNS = (
    "VendorID",
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "passenger_count",
    "trip_distance",
    "PULocationID",
    "DOLocationID",
    "RatecodeID",
    "payment_type",
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "improvement_surcharge",
    "total_amount",
    "congestion_surcharge",
)

TEMPORAL_COLUMNS = (
    "pickup_date",
    "hour",
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    "is_rush_hour",
    "trip_duration_minutes",
)

ZONE_COLUMNS = (
    "pickup_borough",
    "pickup_zone",
    "pickup_service_zone",
    "dropoff_borough",
    "dropoff_zone",
    "dropoff_service_zone",
)

PARTITION_KEYS = ("pickup_date", "hour")

# Feature table, declared order (36 columns).
FEATURE_TABLE_COLUMNS = (
    "PULocationID",
    "DOLocationID",
    "h3_pickup_index",
    "h3_dropoff_index",
    "pickup_date",
    "hour",
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    "is_rush_hour",
    "trip_distance",
    "trip_duration_minutes",
    "passenger_count",
    "fare_amount",
    "total_amount",
    "demand_15min",
    "demand_30min",
    "demand_60min",
    "supply_baseline",
    "demand_zscore",
    "fare_per_mile",
    "fare_per_minute",
    "speed_mph",
    "demand_acceleration",
    "demand_trend",
    "congestion_indicator",
    "temperature_f",
    "precipitation_in",
    "wind_speed_mph",
    "visibility_miles",
    "weather_is_clear",
    "weather_is_rain",
    "weather_is_snow",
    "weather_is_fog",
    "surge_multiplier",
)

# Model inputs, declared order (32 columns).
MODEL_FEATURES = (
    "hour",
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    "is_rush_hour",
    "PULocationID",
    "DOLocationID",
    "trip_distance",
    "trip_duration_minutes",
    "passenger_count",
    "fare_amount",
    "total_amount",
    "demand_15min",
    "demand_30min",
    "demand_60min",
    "supply_baseline",
    "demand_zscore",
    "fare_per_mile",
    "fare_per_minute",
    "speed_mph",
    "demand_acceleration",
    "demand_trend",
    "congestion_indicator",
    "temperature_f",
    "precipitation_in",
    "wind_speed_mph",
    "visibility_miles",
    "weather_is_clear",
    "weather_is_rain",
    "weather_is_snow",
    "weather_is_fog",
)

TARGET = "surge_multiplier"

WEATHER_CONDITIONS = ("Clear", "Rain", "Snow", "Fog")

# Defaults for an hour without weather.
WEATHER_DEFAULTS = {
    "temperature_f": 55.0,
    "precipitation_in": 0.0,
    "wind_speed_mph": 8.0,
    "visibility_miles": 10.0,
}


@dataclass(frozen=True)
class QualityRules:
    min_distance: float = 0.1
    max_distance: float = 200.0
    min_fare: float = 1.0
    max_fare: float = 5000.0
    min_passengers: int = 1
    max_passengers: int = 9
    year: int = 2024
    # Duration bounds in minutes, exclusive at both ends, on the rounded value.
    min_duration: float = 0.5
    max_duration: float = 360.0


@dataclass(frozen=True)
class FeatureRules:
    rolling_minutes: tuple = (15, 30, 60)
    min_surge: float = 1.0
    max_surge: float = 5.0
    # Rush hours as half-open [start, end) ranges.
    morning_rush: tuple = (7, 10)
    evening_rush: tuple = (16, 20)
    speed_cap: float = 100.0
    congestion_speed: float = 10.0
    supply_lookback_days: int = 28
    # Time chunk for the skew-safe rolling window (seconds).
    demand_chunk_seconds: int = 86_400


@dataclass(frozen=True)
class BoostParams:
    max_depth: int = 8
    learning_rate: float = 0.05
    n_rounds: int = 500
    subsample: float = 0.8
    colsample: float = 0.8
    reg_alpha: float = 0.1
    reg_lambda: float = 1.0
    min_child_weight: float = 5.0
    gamma: float = 0.1
    max_bins: int = 256
    early_stopping_rounds: int = 50
    underestimation_penalty: float = 2.0
    validation_fraction: float = 0.2
    seed: int = 42
    # Warm-start (incremental) mode.
    rounds_per_batch: int = 10
    # Write the prediction state every N rounds.
    checkpoint_every: int = 10


@dataclass(frozen=True)
class ScoringRules:
    # Scenario z-score population (mean, sd).
    demand_mean: float = 120.0
    demand_sd: float = 40.0
    rain_precip: float = 0.1
    surge_floor: float = 1.0
    # Text band: < low -> Low, > high -> High, else Moderate.
    band_low: float = 1.2
    band_high: float = 2.0
    # Gauge bands [1, 1.5) green, [1.5, 2.5) yellow, [2.5, 5] red; alert at 4.5.
    gauge_edges: tuple = (1.0, 1.5, 2.5, 5.0)
    gauge_alert: float = 4.5


SURGE_THRESHOLD = 1.2

QUALITY = QualityRules()
FEATURES = FeatureRules()
BOOST = BoostParams()
SCORING = ScoringRules()
