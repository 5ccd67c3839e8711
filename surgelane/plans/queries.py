"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Inputs are always the driver's tables (through the test-data adapter), whole.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelane.config import BOOST, FEATURE_TABLE_COLUMNS, FEATURES, MODEL_FEATURES, RAW_COLUMNS, TARGET
from surgelane.functions.cells import cell, cell_contains, cell_neighbours, cell_parent, cell_path
from surgelane.functions.common import round_doubles, round_half_up
from surgelane.functions.loss import gradient, hessian
from surgelane.operators.boost import BoostedTrees, expectile, node_importances, train_boosted, train_warm_start, warm_start_batches
from surgelane.operators.demand import rolling_demand
from surgelane.operators.derived import add_derived_features
from surgelane.operators.dimensions import add_placeholder_zones, join_zones
from surgelane.operators.evaluate import asymmetric_wmse, evaluate_predictions, top_k
from surgelane.operators.prep import prepare_features, train_val_split
from surgelane.operators.quality import apply_quality_filters, contract_report
from surgelane.operators.scoring import add_bands, linear_surge, scenario_report, score_scenarios
from surgelane.operators.spatial import add_pseudo_coordinates, add_spatial_index
from surgelane.operators.quantiles import RANK_ERROR, daily_sketches, merged_quantiles
from surgelane.operators.supply import attach_bucketed, supply_from_profile, surge_features, surge_profile
from surgelane.operators.weather import hour_spine, integrate_weather
from surgelane.plans.etl import etl_counts, etl_transform, observed_etl
from surgelane.plans.features import feature_table, feature_transform, run_features, write_baseline_state
from surgelane.plans.flagship import clean_trips, saturation_zones, surge_by_borough_hour
from surgelane.plans.model import evaluate_model, load_feature_names, load_importance, save_artifacts
from surgelane.session import delete_on_exit, scratch_path
from surgelane.sinks.tables import output_directories, output_size, read_feature_table, stored_bytes, write_feature_table, write_partitioned, write_weather_table
from surgelane.sources.files import read_parquet, read_partitioned, read_weather, read_zone_csv, tolerant_select
from surgelane.sources.testdata import events_to_trips, trips_from_events, weather_from_events, zones_from_tables
from surgelane.streaming.demand import start_demand_stream, stream_rolling_demand
from surgelane.streaming.dimensions import add_zone_version, start_versioned_stream
from surgelane.streaming.etl import start_etl_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from_events(spark, sf_dir)


def _scratch(spark: SparkSession, name: str) -> str:
    """A path for a table of this session: it goes when the driver's JVM ends."""
    path = scratch_path(spark, name)
    delete_on_exit(spark, path)
    return path


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_trips(_trips(spark, sf_dir))


# --- sources / filters / calendar -------------------------------------------

@query("scan_prune")
def q_scan_prune(spark, sf_dir):
    return tolerant_select(_trips(spark, sf_dir), RAW_COLUMNS)


@query("scan_drift")
def q_scan_drift(spark, sf_dir):
    """Three files whose types and columns drift, read as one table.

    Passenger counts are int, long and double; location ids int and long; the
    last two files have a fee, under two spellings.
    """
    trips = _trips(spark, sf_dir).withColumn("airport_fee", F.col("total_amount") / 4.0)
    path = _scratch(spark, "drift")
    kinds = (("int", "int", None), ("long", "long", "airport_fee"), ("double", "int", "Airport_fee"))
    for k, (passengers, location, fee) in enumerate(kinds):
        part = trips.where(F.col("trip_id") % 3 == k).withColumns(
            {"passenger_count": F.col("passenger_count").cast(passengers), "PULocationID": F.col("PULocationID").cast(location)}
        )
        part = part.withColumnRenamed("airport_fee", fee) if fee else part.drop("airport_fee")
        part.coalesce(1).write.parquet(f"{path}/month{k}")
    columns = ("trip_id", "passenger_count", "PULocationID", "trip_distance", "airport_fee")
    return round_doubles(read_parquet(spark, [f"{path}/month{k}/*.parquet" for k in range(3)], columns))


@query("quality_filter")
def q_quality_filter(spark, sf_dir):
    return apply_quality_filters(_trips(spark, sf_dir))


@query("temporal_features")
def q_temporal_features(spark, sf_dir):
    return _clean(spark, sf_dir).select(
        "trip_id", "pickup_date", "hour", "day_of_week", "day_of_month", "month",
        "is_weekend", "is_rush_hour", "trip_duration_minutes",
    )


@query("zone_scan")
def q_zone_scan(spark, sf_dir):
    """Zones written as a header CSV to the shared folder, read back with the fixed schema."""
    path = _scratch(spark, "zones_csv")
    zones_from_tables(spark, sf_dir).coalesce(1).write.mode("overwrite").option(
        "header", "true"
    ).csv(path)
    return read_zone_csv(spark, path)


@query("zone_join")
def q_zone_join(spark, sf_dir):
    out = join_zones(_clean(spark, sf_dir), zones_from_tables(spark, sf_dir))
    return out.select(
        "trip_id", "PULocationID", "DOLocationID",
        "pickup_borough", "pickup_zone", "pickup_service_zone",
        "dropoff_borough", "dropoff_zone", "dropoff_service_zone",
    )


@query("zone_placeholder")
def q_zone_placeholder(spark, sf_dir):
    out = add_placeholder_zones(apply_quality_filters(_trips(spark, sf_dir)))
    return out.select(
        "trip_id", "pickup_borough", "pickup_zone", "pickup_service_zone",
        "dropoff_borough", "dropoff_zone", "dropoff_service_zone",
    )


@query("etl_counts")
def q_etl_counts(spark, sf_dir):
    """What the ETL write counted while it ran, and the bytes that it left."""
    out, seen = observed_etl(_trips(spark, sf_dir), zones_from_tables(spark, sf_dir))
    path = write_partitioned(out, _scratch(spark, "observed"))
    counts = etl_counts(seen)
    files = output_size(spark.read.parquet(path)).first()
    row = {**counts, "bytes_agree": stored_bytes(spark, path) >= files["bytes"] > 0}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'boolean' if c == 'bytes_agree' else 'long'}" for c in row))


# --- demand / supply / surge -------------------------------------------------

@query("rolling_demand")
def q_rolling_demand(spark, sf_dir):
    return rolling_demand(_clean(spark, sf_dir)).select(
        "trip_id", "pickup_unix_ts", "demand_15min", "demand_30min", "demand_60min"
    )


@query("supply_baseline")
def q_supply_baseline(spark, sf_dir):
    prof = surge_profile(_clean(spark, sf_dir))
    base = supply_from_profile(prof)
    return base.select(
        "PULocationID", "hour", "day_of_week",
        round_half_up(F.col("supply_baseline"), 6).alias("supply_baseline"),
        round_half_up(F.col("supply_stddev"), 6).alias("supply_stddev"),
        "sample_count",
    )


@query("surge")
def q_surge(spark, sf_dir):
    out = surge_features(_clean(spark, sf_dir))
    return out.select(
        "trip_id", "demand_60min",
        round_half_up(F.col("supply_baseline"), 6).alias("supply_baseline"),
        round_half_up(F.col("surge_multiplier"), 6).alias("surge_multiplier"),
    )


@query("joinback_bucketed")
def q_joinback_bucketed(spark, sf_dir):
    """Surge joined to trips kept in buckets of (location, second)."""
    trips = _clean(spark, sf_dir)
    table = f"trips_by_second_{uuid.uuid4().hex[:12]}"
    columns = ["demand_60min", "supply_baseline", "surge_multiplier"]
    out = attach_bucketed(trips, surge_profile(trips), columns, table, _scratch(spark, "trips_by_second"))
    return round_doubles(out.select("trip_id", *columns))


@query("demand_zscore")
def q_demand_zscore(spark, sf_dir):
    out = surge_features(_clean(spark, sf_dir))
    return out.select("trip_id", round_half_up(F.col("demand_zscore"), 6).alias("demand_zscore"))


@query("flagship")
def q_flagship(spark, sf_dir):
    return surge_by_borough_hour(_trips(spark, sf_dir), zones_from_tables(spark, sf_dir))


@query("supply_lookback")
def q_supply_lookback(spark, sf_dir):
    out = surge_features(_clean(spark, sf_dir), lookback_days=FEATURES.supply_lookback_days)
    return out.select(
        "trip_id",
        round_half_up(F.col("supply_baseline"), 6).alias("supply_baseline"),
        round_half_up(F.col("surge_multiplier"), 6).alias("surge_multiplier"),
        round_half_up(F.col("demand_zscore"), 6).alias("demand_zscore"),
    )


# --- weather / derived / spatial / feature table -----------------------------

def _weather(spark, sf_dir):
    return weather_from_events(spark, sf_dir)


@query("hour_spine")
def q_hour_spine(spark, sf_dir):
    return hour_spine(_trips(spark, sf_dir))


@query("weather_classify")
def q_weather_classify(spark, sf_dir):
    return round_doubles(_weather(spark, sf_dir))


@query("weather_file")
def q_weather_file(spark, sf_dir):
    """Weather written as the weather table and read back by the file reader."""
    return round_doubles(read_weather(spark, write_weather_table(_weather(spark, sf_dir), _scratch(spark, "weather"))))


@query("weather_join")
def q_weather_join(spark, sf_dir):
    out = integrate_weather(_clean(spark, sf_dir), _weather(spark, sf_dir))
    return round_doubles(
        out.select("trip_id", "temperature_f", "precipitation_in", "wind_speed_mph",
                   "visibility_miles", "weather_condition")
    )


@query("weather_onehot")
def q_weather_onehot(spark, sf_dir):
    out = integrate_weather(_clean(spark, sf_dir), _weather(spark, sf_dir))
    return out.select("trip_id", "weather_is_clear", "weather_is_rain", "weather_is_snow", "weather_is_fog")


@query("derived_features")
def q_derived_features(spark, sf_dir):
    out = add_derived_features(surge_features(_clean(spark, sf_dir)))
    return round_doubles(
        out.select("trip_id", "fare_per_mile", "fare_per_minute", "speed_mph",
                   "demand_acceleration", "demand_trend", "congestion_indicator")
    )


@query("pseudo_coords")
def q_pseudo_coords(spark, sf_dir):
    out = add_pseudo_coordinates(_clean(spark, sf_dir))
    return round_doubles(
        out.select("trip_id", "pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude"),
        8,
    )


@query("spatial_fallback")
def q_spatial_fallback(spark, sf_dir):
    return add_spatial_index(_clean(spark, sf_dir), "location").select(
        "trip_id", "h3_pickup_index", "h3_dropoff_index"
    )


@query("hex_bin")
def q_hex_bin(spark, sf_dir):
    return add_spatial_index(_clean(spark, sf_dir), "pseudo_hex").select(
        "trip_id", "h3_pickup_index", "h3_dropoff_index"
    )


def _with_coordinates(spark, sf_dir):
    """Trips with coordinates: the pseudo coordinates of their zones, moved a little by trip."""
    trips = add_pseudo_coordinates(_clean(spark, sf_dir))
    moved = F.col("trip_id") % 1000 / 20_000.0
    return trips.withColumns({c: F.col(c) + moved for c in ("pickup_latitude", "dropoff_latitude")})


@query("coordinate_cells")
def q_coordinate_cells(spark, sf_dir):
    """Hexagons and hierarchical cells of trips that carry coordinates."""
    out = add_spatial_index(_with_coordinates(spark, sf_dir))
    fine = cell(F.col("pickup_latitude"), F.col("pickup_longitude"), 16)
    out = out.withColumn("fine", fine).withColumn("coarse", cell_parent(F.col("fine"), 4))
    return out.select(
        "trip_id", "h3_pickup_index", "h3_dropoff_index", cell_path(F.col("fine")).alias("fine_path"), cell_path(F.col("coarse")).alias("coarse_path"),
        cell_contains(F.col("coarse"), F.col("fine")).alias("contained"),
        F.array_join(F.transform(cell_neighbours(F.col("fine"), 16), cell_path), ",").alias("around"),
    )


@query("feature_table")
def q_feature_table(spark, sf_dir):
    return round_doubles(feature_table(_clean(spark, sf_dir), _weather(spark, sf_dir)))


def _processed_table(spark, sf_dir) -> str:
    processed = etl_transform(_trips(spark, sf_dir), zones_from_tables(spark, sf_dir))
    return write_partitioned(processed, _scratch(spark, "processed"))


@query("partition_roundtrip")
def q_partition_roundtrip(spark, sf_dir):
    back = read_partitioned(spark, _processed_table(spark, sf_dir))
    return round_doubles(
        back.select("trip_id", "pickup_date", "hour", "PULocationID", "pickup_borough",
                    "dropoff_zone", "trip_duration_minutes")
    )


@query("output_directories")
def q_output_directories(spark, sf_dir):
    return output_directories(read_partitioned(spark, _processed_table(spark, sf_dir)))


@query("feature_roundtrip")
def q_feature_roundtrip(spark, sf_dir):
    """The feature table written by date and read back by its reader."""
    table = feature_table(_clean(spark, sf_dir), _weather(spark, sf_dir))
    return round_doubles(read_feature_table(spark, write_feature_table(table, _scratch(spark, "features"))))


# The dates that the range query replaces.
RANGE = ("2024-01-08", "2024-01-14")


@query("features_range")
def q_features_range(spark, sf_dir):
    """A date range run from the written processed table and the baseline state of an earlier run; equals a full run's rows of those dates."""
    processed = _processed_table(spark, sf_dir)
    state = write_baseline_state(spark, processed, _scratch(spark, "baseline_state"))
    path = run_features(spark, processed, _weather(spark, sf_dir), _scratch(spark, "features_range"), *RANGE, baseline_path=state)
    return round_doubles(read_feature_table(spark, path))


# --- reports ---------------------------------------------------------------------

@query("saturation_zones")
def q_saturation_zones(spark, sf_dir):
    return round_doubles(saturation_zones(_trips(spark, sf_dir), zones_from_tables(spark, sf_dir)))


@query("actual_vs_predicted")
def q_actual_vs_predicted(spark, sf_dir):
    scored = linear_surge(_features_with_id(spark, sf_dir))
    return round_doubles(
        scored.groupBy("pickup_date", "hour").agg(
            F.count(F.lit(1)).alias("trips"), F.avg(TARGET).alias("actual_surge"), F.avg("prediction").alias("predicted_surge")
        )
    )


# --- model phase -----------------------------------------------------------------

def _features_with_id(spark, sf_dir):
    return feature_transform(_clean(spark, sf_dir), _weather(spark, sf_dir))


def _prepared(spark, sf_dir):
    prepared, names = prepare_features(_features_with_id(spark, sf_dir), keep=["trip_id"])
    return train_val_split(prepared, key="trip_id"), names


@query("median_fill")
def q_median_fill(spark, sf_dir):
    prepared, _ = _prepared(spark, sf_dir)
    return round_doubles(prepared.select("trip_id", "passenger_count"))


QUANTILES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


@query("quantile_ranks")
def q_quantile_ranks(spark, sf_dir):
    """Quantiles of a range of days from written daily sketches, held against the exact ranks of the values."""
    columns = ["trip_distance", "fare_amount", "trip_duration_minutes"]
    trips = _clean(spark, sf_dir)
    path = _scratch(spark, "daily_sketches")
    daily_sketches(trips, columns).write.partitionBy("date").parquet(path)
    found = merged_quantiles(spark.read.parquet(path), QUANTILES, *RANGE)
    days = trips.where(F.col("pickup_date").between(*(F.lit(d).cast("date") for d in RANGE)))
    values = days.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])))
    ranks = values.join(F.broadcast(found), "column").groupBy("column", "p", "n").agg(
        F.count(F.when(F.col("v") < F.col("value"), 1)).alias("below"), F.count(F.when(F.col("v") <= F.col("value"), 1)).alias("upto")
    )
    slack = F.col("n") * RANK_ERROR + 1
    good = (F.col("below") - slack <= F.col("p") * F.col("n")) & (F.col("p") * F.col("n") <= F.col("upto") + slack)
    return ranks.select("column", "p", "n", good.alias("within_bound"))


@query("feature_matrix")
def q_feature_matrix(spark, sf_dir):
    prepared, names = _prepared(spark, sf_dir)
    return round_doubles(prepared.select("trip_id", *names, TARGET))


@query("train_val_split")
def q_train_val_split(spark, sf_dir):
    prepared, _ = _prepared(spark, sf_dir)
    return prepared.select("trip_id", "is_validation")


def _linear_scored(spark, sf_dir):
    feats = train_val_split(_features_with_id(spark, sf_dir), key="trip_id")
    return linear_surge(feats)


@query("asym_grad_hess")
def q_asym_grad_hess(spark, sf_dir):
    s = _linear_scored(spark, sf_dir)
    y, p = F.col(TARGET), F.col("prediction")
    return round_doubles(
        s.select("trip_id", "prediction", gradient(y, p).alias("grad"), hessian(y, p).alias("hess"))
    )


@query("asym_wmse")
def q_asym_wmse(spark, sf_dir):
    s = _linear_scored(spark, sf_dir).filter("is_validation")
    return round_doubles(asymmetric_wmse(s, TARGET, "prediction"))


@query("eval_metrics")
def q_eval_metrics(spark, sf_dir):
    s = _linear_scored(spark, sf_dir).filter("is_validation")
    return round_doubles(evaluate_predictions(s, TARGET, "prediction"))


@query("score_scenarios")
def q_score_scenarios(spark, sf_dir):
    scen = _features_with_id(spark, sf_dir).select(
        "trip_id", "hour", "day_of_week", "demand_60min", "supply_baseline",
        "temperature_f", "precipitation_in",
    )
    out = score_scenarios(scen, linear_surge, MODEL_FEATURES, keep=["trip_id"])
    return round_doubles(
        out.select("trip_id", "demand_zscore", "is_weekend", "is_rush_hour", "weather_is_rain",
                   "predicted_surge", "surge_band", "gauge_band", "surge_alert")
    )


@query("surge_bands")
def q_surge_bands(spark, sf_dir):
    feats = _features_with_id(spark, sf_dir).select("trip_id", "surge_multiplier")
    return round_doubles(add_bands(feats, "surge_multiplier"))


@query("base_score")
def q_base_score(spark, sf_dir):
    prepared, _ = _prepared(spark, sf_dir)
    score = expectile(prepared.where("not is_validation"), TARGET, BOOST.underestimation_penalty)
    return round_doubles(spark.createDataFrame([(score,)], "base_score double"))


def _stump(spark, sf_dir) -> BoostedTrees:
    """One unsampled round with one split of a 0/1 feature, saved and loaded: SQL can follow it."""
    prepared, _ = _prepared(spark, sf_dir)
    params = replace(BOOST, n_rounds=1, max_depth=1, subsample=1.0, colsample=1.0, gamma=0.0, min_child_weight=0.0)
    path = _scratch(spark, "stump")
    train_boosted(prepared, ["is_rush_hour"], TARGET, "is_validation", params, early_stopping=False).save(spark, path)
    return BoostedTrees.load(spark, path)


@query("boost_stump")
def q_boost_stump(spark, sf_dir):
    nodes = _stump(spark, sf_dir).nodes(spark)
    return round_doubles(
        nodes.groupBy("tree").agg(
            F.max("feature").alias("feature"), F.max("threshold").alias("threshold"), F.max("gain").alias("gain"),
            F.max(F.when(F.col("node") == 1, F.col("value"))).alias("left_value"),
            F.max(F.when(F.col("node") == 2, F.col("value"))).alias("right_value"),
        )
    )


@query("stump_scenarios")
def q_stump_scenarios(spark, sf_dir):
    """Scenarios scored by a trained, saved and loaded model."""
    model = _stump(spark, sf_dir)
    scen = _features_with_id(spark, sf_dir).select("trip_id", "hour", "day_of_week")
    out = score_scenarios(scen, model.predict, model.features, keep=["trip_id"])
    return round_doubles(out.select("trip_id", "is_rush_hour", "prediction", "predicted_surge", "surge_band", "gauge_band", "surge_alert"))


@query("score_topk")
def q_score_topk(spark, sf_dir):
    """The 20 features of largest mean."""
    prepared, names = _prepared(spark, sf_dir)
    means = prepared.agg(*[F.round(F.avg(c), 4).alias(c) for c in names])
    return top_k(means.unpivot([], names, "feature", "score").select("feature", "score"), 20, "score", "feature")


# Batches of the warm start; each adds the declared rounds.
WARM_BATCHES = 4


@query("warm_start_batches")
def q_warm_start_batches(spark, sf_dir):
    prepared, names = _prepared(spark, sf_dir)
    return warm_start_batches(prepared, names, TARGET, WARM_BATCHES, key="trip_id").select("trip_id", F.col("_batch").alias("batch"))


# Features of two values each, so that SQL can follow every split.
BINARY = ("is_weekend", "is_rush_hour", "congestion_indicator", "weather_is_rain")
BINARY_PARAMS = replace(BOOST, n_rounds=4, learning_rate=0.3, max_depth=1, subsample=1.0, colsample=1.0, gamma=0.0, min_child_weight=0.0, rounds_per_batch=2, checkpoint_every=2)


def _binary_model(spark, sf_dir, folder: str | None = None, stop: int | None = None) -> BoostedTrees:
    """Four rounds of one split each over the binary features; with ``stop``, left after so many and resumed."""
    prepared, _ = _prepared(spark, sf_dir)
    for rounds in [stop, None] if stop else [None]:
        model = train_boosted(prepared, BINARY, TARGET, "is_validation", BINARY_PARAMS, n_rounds=rounds, early_stopping=False, folder=folder)
    return model


def _splits(nodes: DataFrame) -> DataFrame:
    """One row per tree of one split: feature, threshold, gain, cover and the values of both sides."""
    at = lambda node, c: F.max(F.when(F.col("node") == node, F.col(c)))
    return round_doubles(nodes.groupBy("tree").agg(
        at(0, "feature").alias("feature"), at(0, "threshold").alias("threshold"), at(0, "gain").alias("gain"), at(0, "cover").alias("cover"),
        at(1, "value").alias("left_value"), at(2, "value").alias("right_value"), at(1, "cover").alias("left_cover"),
    ))


@query("boost_rounds")
def q_boost_rounds(spark, sf_dir):
    return _splits(_binary_model(spark, sf_dir).nodes(spark))


@query("train_resume")
def q_train_resume(spark, sf_dir):
    """The same run stopped after its third round and gone on with from the written state."""
    return _splits(_binary_model(spark, sf_dir, folder=_scratch(spark, "training_run"), stop=3).nodes(spark))


@query("model_importance")
def q_model_importance(spark, sf_dir):
    """Weight, average and total gain and cover per feature, from the written nodes."""
    path = _scratch(spark, "importance_model")
    _binary_model(spark, sf_dir).save(spark, path)
    return round_doubles(node_importances(spark.read.parquet(f"{path}/nodes")))


def _binary_artifacts(spark, sf_dir) -> str:
    prepared, _ = _prepared(spark, sf_dir)
    model = _binary_model(spark, sf_dir)
    return save_artifacts(spark, evaluate_model(model, prepared.filter("is_validation")), _scratch(spark, "bundle"))


@query("model_metrics")
def q_model_metrics(spark, sf_dir):
    """The metrics that the artifact bundle of a small model holds."""
    metrics = spark.read.json(f"{_binary_artifacts(spark, sf_dir)}/metrics")
    named = ("rmse", "mae", "r2_score", "mape_percent", "directional_accuracy_percent", "under_estimation_rate_percent", "asymmetric_wmse")
    top = F.col("feature_importance_top20")
    return round_doubles(metrics.select(*named, "n_rows", "n_trees", "n_features", top[0]["feature"].alias("top_feature"), F.size(top).cast("long").alias("n_top")))


@query("importance_file")
def q_importance_file(spark, sf_dir):
    """The importance CSV joined to the ordered feature names of the bundle."""
    path = _binary_artifacts(spark, sf_dir)
    gains = spark.read.option("header", "true").schema("feature string, importance_gain double").csv(f"{path}/feature_importance")
    return round_doubles(load_feature_names(spark, path).join(gains, "feature", "left").select("ordinal", "feature", "importance_gain"))


@query("warm_start_rounds")
def q_warm_start_rounds(spark, sf_dir):
    """Two batches of two rounds each over the binary features."""
    prepared, _ = _prepared(spark, sf_dir)
    return _splits(train_warm_start(prepared, BINARY, TARGET, "is_validation", BINARY_PARAMS, 2, key="trip_id").nodes(spark))


# Where a session's full training run over a folder was saved: one run serves all queries on its model.
_SAVED: dict[tuple[str, str], str] = {}


def _saved_model(spark, sf_dir) -> str:
    """Artifacts of a training run with the declared parameters."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        prepared, names = _prepared(spark, sf_dir)
        model = train_boosted(prepared, names, TARGET, "is_validation", BOOST)
        _SAVED[key] = save_artifacts(spark, evaluate_model(model, prepared.filter("is_validation")), _scratch(spark, "model"))
    return _SAVED[key]


def _history(spark, model: BoostedTrees) -> DataFrame:
    rows = [(h["round"], h["train"], h["validation"]) for h in model.history]
    return spark.createDataFrame(rows, "round int, train_wmse double, validation_wmse double")


@query("train_boost")
def q_train_boost(spark, sf_dir):
    return _history(spark, BoostedTrees.load(spark, f"{_saved_model(spark, sf_dir)}/model"))


@query("train_warm_start")
def q_train_warm_start(spark, sf_dir):
    prepared, names = _prepared(spark, sf_dir)
    return _history(spark, train_warm_start(prepared, names, TARGET, "is_validation", BOOST, WARM_BATCHES, key="trip_id"))


@query("importance_topk")
def q_importance_topk(spark, sf_dir):
    model = BoostedTrees.load(spark, f"{_saved_model(spark, sf_dir)}/model")
    return top_k(model.importance(spark), 20, "importance_gain", "feature", digits=4)


@query("model_artifacts")
def q_model_artifacts(spark, sf_dir):
    return load_importance(spark, _saved_model(spark, sf_dir), 10)


# --- streaming ---------------------------------------------------------------------

@query("stream_etl")
def q_stream_etl(spark, sf_dir):
    """The events file replayed as a stream through the ETL phase (availableNow),
    then the appended partitioned table read back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = _scratch(spark, "stream_out")
    q = start_etl_stream(
        spark, sf_dir, schema, out, _scratch(spark, "stream_ckpt"),
        zones=zones_from_tables(spark, sf_dir),
        adapter=events_to_trips,
        glob="events.parquet",
    )
    q.awaitTermination()
    back = read_partitioned(spark, out)
    return round_doubles(
        back.select("trip_id", "pickup_date", "hour", "PULocationID", "pickup_borough",
                    "dropoff_zone", "trip_duration_minutes")
    )


# Days of a file of the replayed stream.
REPLAY_DAYS = 6


@query("stream_demand")
def q_stream_demand(spark, sf_dir):
    """Rolling demand of the events replayed as a stream, a file of some days at a time, each with a heartbeat at its end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path, beats = _scratch(spark, "stream_events"), _scratch(spark, "stream_beats")
    first, last = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    while first <= last:
        end = first + dt.timedelta(days=REPLAY_DAYS)
        events.where((F.to_date("ts") >= F.lit(first)) & (F.to_date("ts") < F.lit(end))).coalesce(1).write.mode("append").parquet(path)
        # The last heartbeat is a day later: it closes the whole stream.
        beat = end + dt.timedelta(days=1) if end > last else end
        spark.createDataFrame([(dt.datetime(beat.year, beat.month, beat.day),)], "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(beats)
        first = end
    read = lambda schema, at: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    trips = clean_trips(events_to_trips(read(events.schema, path)))
    demand = stream_rolling_demand(trips, ["trip_id"], heartbeats=read("ts timestamp_ntz", beats))
    out = _scratch(spark, "stream_demand")
    start_demand_stream(demand, out, _scratch(spark, "stream_demand_ckpt")).awaitTermination()
    return spark.read.parquet(out).select("trip_id", "pickup_unix_ts", "demand_15min", "demand_30min", "demand_60min")


# When the second version of the zones starts to hold.
ZONES_CHANGE = "2024-01-15 12:00:00"


@query("stream_zones")
def q_stream_zones(spark, sf_dir):
    """Trips of a stream named by the zones that held at their pickup; every other zone changes its name once."""
    zones = zones_from_tables(spark, sf_dir)
    versions = add_zone_version(zones, "2024-01-01 00:00:00", _scratch(spark, "zone_versions"))
    changed = zones.where(F.col("LocationID") % 2 == 0).withColumns(
        {"Zone": F.concat(F.lit("New "), F.col("Zone")), "Borough": F.upper("Borough")}
    )
    add_zone_version(changed, ZONES_CHANGE, versions)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    trips = clean_trips(events_to_trips(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)))
    out = _scratch(spark, "stream_zones")
    start_versioned_stream(trips, versions, out, _scratch(spark, "stream_zones_ckpt")).awaitTermination()
    back = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return back.select("trip_id", "pickup_date", "hour", "pickup_borough", "pickup_zone", "dropoff_borough", "dropoff_zone")


@query("scenario_report")
def q_scenario_report(spark, sf_dir):
    scen = _features_with_id(spark, sf_dir).select(
        "trip_id", "hour", "day_of_week", "demand_60min", "supply_baseline",
        "temperature_f", "precipitation_in",
    )
    out = scenario_report(score_scenarios(scen, linear_surge, MODEL_FEATURES, keep=["trip_id"]))
    return out.select("trip_id", "surge_text", "zscore_text", "rush_hour_text", "weekend_text", "raining_text")


@query("contract_report")
def q_contract_report(spark, sf_dir):
    return contract_report(_clean(spark, sf_dir))
