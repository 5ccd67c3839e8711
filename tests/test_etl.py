"""Quality filter, calendar features, zone lookups (phase A)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import edge_trips, plan_text, trip
from surgelane.config import QUALITY
from surgelane.operators.dimensions import (
    add_placeholder_zones,
    enrich_zones,
    join_zones,
)
from surgelane.operators.quality import apply_quality_filters
from surgelane.operators.temporal import extract_temporal_features
from surgelane.plans.flagship import clean_trips


def test_valid_records_pass(sample_trips):
    assert apply_quality_filters(sample_trips).count() == 4


def test_filtered_bounds(sample_trips):
    out = apply_quality_filters(sample_trips)
    row = out.agg(F.min("trip_distance"), F.max("fare_amount"), F.min("total_amount")).first()
    assert row[0] >= QUALITY.min_distance and row[1] <= QUALITY.max_fare and row[2] > 0


def test_empty_input(spark):
    schema = ("tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, trip_distance double, "
              "fare_amount double, passenger_count int, total_amount double")
    empty = spark.createDataFrame([], schema)
    assert apply_quality_filters(empty).count() == 0
    assert extract_temporal_features(apply_quality_filters(empty)).count() == 0


def test_temporal_goldens(sample_trips):
    out = clean_trips(sample_trips).orderBy("tpep_pickup_datetime").collect()
    got = [(r.trip_duration_minutes, r.hour, r.day_of_week, r.is_weekend, r.is_rush_hour) for r in out]
    assert got == [(24.0, 7, 2, 0, 1), (30.0, 19, 2, 0, 1), (12.0, 0, 7, 1, 0), (45.0, 16, 1, 1, 1)]
    assert str(out[0].pickup_date) == "2024-02-05"


def test_boundaries(spark):
    rows = [
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", dist=0.1, trip_id=1),     # keep (edge)
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", dist=200.0, trip_id=2),   # keep (edge)
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", dist=200.01, trip_id=3),  # drop
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", fare=1.0, trip_id=4),      # keep
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", fare=5000.0, trip_id=5),   # keep
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", pax=0, trip_id=6),         # drop
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", pax=9, trip_id=7),         # keep
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", pax=10, trip_id=8),        # drop
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", pax=None, trip_id=9),      # keep
        trip("2023-12-31 23:59:59", "2024-01-01 00:10:00", trip_id=10),               # drop (year)
        trip("2024-01-01 00:00:00", "2024-01-01 00:10:00", trip_id=11),               # keep
        trip("2024-12-31 23:59:59", "2025-01-01 00:10:00", trip_id=12),               # keep
        trip("2025-01-01 00:00:00", "2025-01-01 00:10:00", trip_id=13),               # drop (year)
        trip("2024-05-01 10:00:00", "2024-05-01 10:00:30", trip_id=14),               # 0.5 min: drop
        trip("2024-05-01 10:00:00", "2024-05-01 10:00:31", trip_id=15),               # 0.52: keep
        trip("2024-05-01 10:00:00", "2024-05-01 15:59:59", trip_id=16),               # 359.98: keep
        trip("2024-05-01 10:00:00", "2024-05-01 16:00:00", trip_id=17),               # 360: drop
        trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", total=0.0, trip_id=18),    # drop
        trip("2024-05-01 10:00:00", None, trip_id=19),                                # drop
    ]
    kept = {r.trip_id for r in clean_trips(edge_trips(spark, rows)).collect()}
    assert kept == {1, 2, 4, 5, 7, 9, 11, 12, 15, 16}


def test_rush_and_weekend(spark):
    hours = [6, 7, 9, 10, 15, 16, 19, 20]
    rows = [trip(f"2024-05-01 {h:02d}:05:00", f"2024-05-01 {h:02d}:15:00", trip_id=h) for h in hours]
    rows += [trip("2024-05-04 12:00:00", "2024-05-04 12:10:00", trip_id=100),   # Saturday
             trip("2024-05-05 12:00:00", "2024-05-05 12:10:00", trip_id=101)]   # Sunday
    out = {r.trip_id: r for r in clean_trips(edge_trips(spark, rows)).collect()}
    assert {h: out[h].is_rush_hour for h in hours} == {6: 0, 7: 1, 9: 1, 10: 0, 15: 0, 16: 1, 19: 1, 20: 0}
    assert (out[100].day_of_week, out[100].is_weekend) == (7, 1)
    assert (out[101].day_of_week, out[101].is_weekend) == (1, 1)
    assert out[7].is_weekend == 0


def test_year_filter_is_pushed_to_scan(spark):
    from surgelane.sources.testdata import trips_from_events

    plan = plan_text(apply_quality_filters(trips_from_events(spark, "/root/testdata/sf0.001")))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan and "LessThan(ts,2025-01-01T00:00)" in plan


def test_zone_join(sample_trips, sample_zones):
    filtered = apply_quality_filters(sample_trips)
    out = join_zones(filtered, sample_zones)
    assert out.count() == filtered.count()
    assert out.filter(F.col("pickup_borough").isNull() | F.col("dropoff_zone").isNull()).count() == 0
    row = out.filter(F.col("PULocationID") == 7).first()
    assert (row.pickup_borough, row.pickup_zone, row.dropoff_borough) == ("South", "Airfield", "North")


def test_unknown_zone_stays_null(spark, sample_zones):
    rows = [trip("2024-05-01 10:00:00", "2024-05-01 10:10:00", pu=999, do=3, trip_id=1)]
    row = join_zones(edge_trips(spark, rows), sample_zones).first()
    assert row.pickup_borough is None and row.dropoff_borough == "North"


def test_duplicate_zone_key_refused(spark, sample_trips, sample_zones):
    dup = sample_zones.union(sample_zones.limit(1))
    with pytest.raises(Exception, match="DuplicateDimensionKey"):
        join_zones(sample_trips, dup).collect()
    nulls = sample_zones.union(sample_zones.withColumn("LocationID", F.lit(None).cast("int")))
    assert join_zones(sample_trips, nulls).count() == 7


def test_building_a_lookup_runs_no_job(spark, sample_trips, sample_zones):
    spark.sparkContext.setJobGroup("lookup", "plan building")
    try:
        join_zones(sample_trips, sample_zones)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lookup")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_placeholder_zones(sample_trips):
    out = add_placeholder_zones(apply_quality_filters(sample_trips))
    assert out.count() == 4
    assert out.filter(F.col("pickup_borough").isNull()).count() == 0
    assert {r.pickup_zone for r in out.collect()} == {"Zone_3", "Zone_4", "Zone_9", "Zone_7"}
    assert enrich_zones(sample_trips, None).columns[-6:] == [
        "pickup_borough", "pickup_zone", "pickup_service_zone",
        "dropoff_borough", "dropoff_zone", "dropoff_service_zone",
    ]


def test_contract_report(sample_trips):
    from surgelane.operators.quality import contract_report

    r = contract_report(clean_trips(sample_trips)).first()
    assert r.n_rows == 4 and r.bad_flags == 0 and r.null_passengers == 1
    assert (r.min_pickup_year, r.max_pickup_year) == (2024, 2024)
    assert r.min_trip_distance >= 0.1 and r.max_fare_amount <= 5000 and r.min_total_amount > 0
    assert 0 <= r.min_hour and r.max_hour <= 23 and 0.5 < r.min_duration and r.max_duration < 360


def drift(spark, path, k, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/f{k}")


def test_drifting_files_are_read_whole(spark, tmp_path):
    """int, long, double; a column that only some files have; two spellings; dates and timestamps."""
    from surgelane.sources.files import read_parquet

    path = str(tmp_path / "drift files")
    drift(spark, path, 1, [(1, 2, "2024-01-01")], "id int, n int, day string")
    drift(spark, path, 2, [(2**40, 3, 0.5)], "id long, n long, Fee double")
    drift(spark, path, 3, [(3, 2.5, 1.5)], "id int, n double, fee double")
    drift(spark, path, 4, [(4, None, None)], "id int, n int, fee float")
    df = read_parquet(spark, f"{path}/*/*.parquet", None)
    assert dict(df.dtypes) == {"id": "bigint", "n": "double", "day": "string", "Fee": "double"}
    assert sorted(tuple(r) for r in df.select("id", "n", "day", "Fee").collect()) == [
        (1, 2.0, "2024-01-01", None), (3, 2.5, None, 1.5), (4, None, None, None), (2**40, 3.0, None, 0.5)
    ]
    # Pruned and filtered in each scan.
    plan = plan_text(df.select("n").where("n > 2"))
    assert "day" not in "".join(ln for ln in plan.splitlines() if "ReadSchema" in ln) and plan.count("PushedFilters: [IsNotNull(n), GreaterThan(n,2") == 3


def test_like_files_are_one_scan(spark, tmp_path):
    from surgelane.sources.files import read_parquet

    path = str(tmp_path)
    for k in range(6):
        drift(spark, path, k, [(k, 1 if k % 2 else 1.5)], "id int, n int" if k % 2 else "id int, n double")
    df = read_parquet(spark, f"{path}/*", None)
    assert sorted(r.n for r in df.collect()) == [1.0] * 3 + [1.5] * 3
    assert plan_text(df, "simple").count("FileScan") == 2


def test_widest_types():
    from pyspark.sql import types as T

    from surgelane.sources.files import reconcile, widest

    assert widest(T.IntegerType(), T.LongType()) == T.LongType() and widest(T.LongType(), T.FloatType()) == T.DoubleType()
    assert widest(T.DecimalType(10, 2), T.IntegerType()) == T.DecimalType(12, 2)
    assert widest(T.DecimalType(38, 10), T.LongType()) == T.DecimalType(38, 10)
    assert widest(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType() and widest(T.NullType(), T.DateType()) == T.DateType()
    assert widest(T.TimestampType(), T.DateType()) == T.TimestampType() and widest(T.StringType(), T.IntegerType()) == T.StringType()
    with pytest.raises(ValueError, match="column A"):
        reconcile([T.StructType([T.StructField("a", T.ArrayType(T.IntegerType()))]), T.StructType([T.StructField("A", T.StringType())])])
