"""Phase runner, partitioned re-read, streaming ETL and plan-shape checks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE, plan_text
from surgelane.plans.etl import etl_transform
from surgelane.plans.features import feature_table
from surgelane.plans.flagship import clean_trips
from surgelane.plans.jobs import parser, run
from surgelane.session import scratch_path
from surgelane.sinks.tables import output_size, write_partitioned
from surgelane.sources.files import read_partitioned
from surgelane.sources.testdata import (
    events_to_trips,
    trips_from_events,
    weather_from_events,
    zones_from_tables,
)
from surgelane.streaming.etl import start_etl_stream


def test_partition_pruning_on_reread(spark):
    path = write_partitioned(etl_transform(trips_from_events(spark, SMOKE), zones_from_tables(spark, SMOKE)),
                             scratch_path(spark, "processed_test"))
    whole = read_partitioned(spark, path)
    part = read_partitioned(spark, path, date_from="2024-01-10", date_to="2024-01-12", hours=[8, 9])
    assert dict(whole.dtypes)["pickup_date"] == "date" and dict(whole.dtypes)["hour"] == "int"
    plan = plan_text(part)
    assert "PartitionFilters: [isnotnull(pickup_date" in plan
    expected = whole.filter(F.col("pickup_date").between("2024-01-10", "2024-01-12") & F.col("hour").isin(8, 9))
    assert part.count() == expected.count() > 0
    size = output_size(whole).first()
    assert size.files >= 1 and size.bytes > 0


def test_feature_table_stays_in_jvm(spark):
    t = trips_from_events(spark, SMOKE)
    df = feature_table(clean_trips(t), weather_from_events(spark, SMOKE))
    assert len(df.columns) == 36
    plan = plan_text(df, "simple")
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_streaming_etl(spark):
    schema = spark.read.parquet(f"{SMOKE}/events.parquet").schema
    out = scratch_path(spark, "stream_test")
    q = start_etl_stream(spark, SMOKE, schema, out, scratch_path(spark, "stream_test_ckpt"),
                         zones=zones_from_tables(spark, SMOKE), adapter=events_to_trips, glob="events.parquet")
    q.awaitTermination()
    streamed = read_partitioned(spark, out)
    batch = etl_transform(trips_from_events(spark, SMOKE), zones_from_tables(spark, SMOKE))
    assert streamed.count() == batch.count() > 0
    assert streamed.select("trip_id").exceptAll(batch.select("trip_id")).count() == 0


def test_phase_runner(spark):
    raw = scratch_path(spark, "raw")
    days = trips_from_events(spark, SMOKE).where("tpep_pickup_datetime >= '2024-01-09' and tpep_pickup_datetime < '2024-01-13'")
    days.coalesce(1).write.parquet(raw)
    zones_csv = scratch_path(spark, "zones")
    zones_from_tables(spark, SMOKE).coalesce(1).write.option("header", "true").csv(zones_csv)
    weather = scratch_path(spark, "weather")
    weather_from_events(spark, SMOKE).write.parquet(weather)
    processed, feats, model = (scratch_path(spark, n) for n in ("processed", "features", "model"))
    args = parser().parse_args([
        "--raw", raw, "--zones", zones_csv, "--weather", weather, "--processed", processed,
        "--features", feats, "--model-dir", model, "--rounds", "2", "--learning-rate", "0.3",
    ])
    done = run(spark, args)
    assert list(done) == ["etl", "features", "model"]
    assert len(spark.read.parquet(feats).columns) == 36
    metrics = spark.read.json(f"{model}/metrics").first()
    assert metrics.n_features == 32 and metrics.rmse >= 0
    before_range = spark.read.parquet(feats).count()
    only = parser().parse_args(["--only-features", "--processed", processed, "--features", feats,
                                "--model-dir", model, "--weather", weather,
                                "--date-from", "2024-01-10", "--date-to", "2024-01-12"])
    assert list(run(spark, only)) == ["features"]
    after = spark.read.parquet(feats)
    assert after.count() == before_range


def test_date_range_equals_a_full_run_and_keeps_other_days(spark):
    from surgelane.plans.features import run_features
    from surgelane.sinks.tables import read_feature_table

    trips = trips_from_events(spark, SMOKE)
    weather = weather_from_events(spark, SMOKE)
    processed = write_partitioned(etl_transform(trips, zones_from_tables(spark, SMOKE)), scratch_path(spark, "processed_range"))
    out = run_features(spark, processed, weather, scratch_path(spark, "features_range"))
    full = [tuple(r) for r in read_feature_table(spark, out).collect()]
    assert len(read_feature_table(spark, out).columns) == 36
    run_features(spark, processed, weather, out, date_from="2024-01-10", date_to="2024-01-12")
    again = [tuple(r) for r in read_feature_table(spark, out).collect()]
    assert sorted(again, key=repr) == sorted(full, key=repr)
    only = run_features(spark, processed, weather, scratch_path(spark, "features_days"), "2024-01-10", "2024-01-12")
    days = read_feature_table(spark, only)
    assert {str(r.pickup_date) for r in days.select("pickup_date").distinct().collect()} <= {"2024-01-10", "2024-01-11", "2024-01-12"}
    at = days.columns.index("pickup_date")
    want = [r for r in full if "2024-01-10" <= str(r[at]) <= "2024-01-12"]
    assert sorted((tuple(r) for r in days.collect()), key=repr) == sorted(want, key=repr)


def test_date_range_needs_the_whole_baseline(spark):
    from surgelane.operators.supply import surge_features

    trips = clean_trips(trips_from_events(spark, SMOKE))
    with pytest.raises(ValueError, match="baseline"):
        surge_features(trips, since="2024-01-10")


def test_empty_input_is_refused(spark):
    from surgelane.plans.etl import run_etl

    raw = scratch_path(spark, "empty_raw")
    trips_from_events(spark, SMOKE).limit(0).write.parquet(raw)
    with pytest.raises(ValueError, match="empty"):
        run_etl(spark, raw, scratch_path(spark, "never"))


def test_join_back_never_broadcasts_profile(spark):
    from surgelane.operators.supply import surge_features

    plan = plan_text(surge_features(clean_trips(trips_from_events(spark, SMOKE))), "simple")
    assert "SortMergeJoin" in plan
    assert "ShuffledHashJoin" not in plan and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_flagship_plan_needs_no_jobs_beyond_the_footer(spark):
    from surgelane.plans.flagship import surge_by_borough_hour

    spark.sparkContext.setJobGroup("flagship", "plan building")
    try:
        surge_by_borough_hour(trips_from_events(spark, SMOKE), zones_from_tables(spark, SMOKE))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("flagship")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_flagship_shuffles_no_trip_rows(spark):
    from surgelane.plans.flagship import surge_by_borough_hour

    df = surge_by_borough_hour(trips_from_events(spark, SMOKE), zones_from_tables(spark, SMOKE))
    plan = plan_text(df, "simple")
    assert plan.count("events.parquet") == 1
    lines = [ln.strip() for ln in plan.splitlines()]
    scan = next(i for i, ln in enumerate(lines) if "events.parquet" in ln)
    # Walking up from the scan, the first exchange sits above a partial (map-side) aggregate.
    above = lines[:scan][::-1]
    first_exchange = next(i for i, ln in enumerate(above) if "Exchange hashpartitioning" in ln)
    assert any("partial_count" in ln for ln in above[:first_exchange])
