"""Streaming demand, zone versions, buckets, observed writes, cells, sketches, baseline state."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMOKE, direct_demand, edge_trips, plan_text, trip
from surgelane.functions.cells import cell, cell_children, cell_contains, cell_neighbours, cell_parent, cell_path, cell_resolution
from surgelane.plans.flagship import clean_trips
from surgelane.session import scratch_path
from surgelane.sources.testdata import trips_from_events, zones_from_tables


def drop_files(spark, folder, *parts):
    """Write one file a part, in order."""
    for rows in parts:
        edge_trips(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def replay(spark, folder, beats, delay="10 minutes"):
    from surgelane.streaming.demand import start_demand_stream, stream_rolling_demand

    schema = edge_trips(spark, []).schema
    read = lambda s, at: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(at)
    out = scratch_path(spark, "demand_out")
    demand = stream_rolling_demand(read(schema, folder), ["trip_id"], delay, heartbeats=read("ts timestamp_ntz", beats))
    start_demand_stream(demand, out, scratch_path(spark, "demand_ckpt")).awaitTermination()
    return sorted((r.trip_id, r.demand_15min, r.demand_30min, r.demand_60min) for r in spark.read.parquet(out).collect())


def beat(spark, folder, *times):
    for t in times:
        spark.createDataFrame([(dt.datetime.fromisoformat(t),)], "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)


def test_streamed_demand_is_exact_and_late_trips_count_nowhere(spark):
    """Out of order within the delay, peers in one second, the turn of a day, several locations; a trip behind the watermark is dropped."""
    at = lambda k, t, pu=1: trip(f"2024-03-05 {t}", "2024-03-05 23:59:59", pu=pu, trip_id=k)
    first = [at(1, "22:10:00"), at(3, "22:58:00"), at(2, "22:30:00"), at(4, "22:58:00"), at(5, "22:59:59", 2), at(13, "22:20:00", None)]
    second = [at(6, "22:57:30"), at(7, "23:10:00"), at(8, "23:50:00"), at(9, "23:45:00", 2)]
    late = at(10, "22:00:00")
    third = [trip("2024-03-06 00:05:00", "2024-03-06 01:00:00", trip_id=11), trip("2024-03-06 00:30:00", "2024-03-06 01:00:00", pu=2, trip_id=12), late]
    folder, beats = scratch_path(spark, "late_trips"), scratch_path(spark, "late_beats")
    drop_files(spark, folder, first, second, third)
    beat(spark, beats, "2024-03-05T23:00:00", "2024-03-05T23:50:00", "2024-03-07T00:00:00")
    want = direct_demand(edge_trips(spark, first + second + third[:2]))
    want = sorted((r.trip_id, r.demand_15min, r.demand_30min, r.demand_60min) for r in want.collect())
    assert replay(spark, folder, beats) == want


def test_open_seconds_wait(spark):
    """Without the closing heartbeat, the last minutes are not emitted: a trip could still come."""
    folder, beats = scratch_path(spark, "open_trips"), scratch_path(spark, "open_beats")
    drop_files(spark, folder, [trip("2024-03-05 10:00:00", "2024-03-05 11:00:00", trip_id=1), trip("2024-03-05 10:30:00", "2024-03-05 11:00:00", trip_id=2)])
    beat(spark, beats, "2024-03-05T10:30:00")
    assert [r[0] for r in replay(spark, folder, beats)] == [1]


def test_zone_versions(spark, sample_zones):
    from surgelane.streaming.dimensions import add_zone_version, join_zones_as_of, zone_versions

    path = add_zone_version(sample_zones, "2024-02-01 00:00:00", scratch_path(spark, "versions"))
    add_zone_version(sample_zones.where("LocationID = 3").withColumn("Zone", F.lit("Pier")), "2024-02-05 19:00:00", path)
    rows = [trip("2024-02-05 18:59:59", "2024-02-05 20:00:00", pu=3, do=4, trip_id=1), trip("2024-02-05 19:00:00", "2024-02-05 20:00:00", pu=3, do=3, trip_id=2),
            trip("2024-01-31 10:00:00", "2024-01-31 11:00:00", pu=3, do=9, trip_id=3), trip("2024-03-01 10:00:00", "2024-03-01 11:00:00", pu=None, do=77, trip_id=4)]
    got = {r.trip_id: (r.pickup_zone, r.dropoff_zone) for r in join_zones_as_of(edge_trips(spark, rows), zone_versions(spark, path)).collect()}
    assert got == {1: ("Harbour", "Market"), 2: ("Pier", "Pier"), 3: (None, None), 4: (None, None)}
    add_zone_version(sample_zones.where("LocationID = 3"), "2024-02-05 19:00:00", path)
    with pytest.raises(Exception, match="DuplicateDimensionKey"):
        zone_versions(spark, path).collect()


def test_bucketed_trips_are_not_shuffled(spark):
    from surgelane.operators.supply import attach_bucketed, surge_features, surge_profile

    trips = clean_trips(trips_from_events(spark, SMOKE))
    trips = trips.withColumn("PULocationID", F.when(F.col("trip_id") % 7 > 0, F.col("PULocationID")))
    columns = ["demand_15min", "surge_multiplier"]
    out = attach_bucketed(trips, surge_profile(trips), columns, "bucketed_test", scratch_path(spark, "bucketed"), 6)
    plan = plan_text(out, "simple")
    before = plan[: plan.index("Bucketed: true")]
    # Between the join and the table of trips there is no exchange.
    assert "SortMergeJoin" in before and "Exchange" not in before[before.rindex("SortMergeJoin"):], plan
    want = surge_features(trips).select("trip_id", *columns)
    assert sorted(map(tuple, out.select("trip_id", *columns).collect())) == sorted(map(tuple, want.collect()))


def test_observed_write_counts_as_it_runs(spark):
    from surgelane.plans.etl import etl_counts, etl_transform, observed_etl
    from surgelane.sinks.tables import write_partitioned

    trips, zones = trips_from_events(spark, SMOKE), zones_from_tables(spark, SMOKE)

    def jobs(df, name):
        spark.sparkContext.setJobGroup(name, name)
        try:
            write_partitioned(df, scratch_path(spark, name))
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    plain = jobs(etl_transform(trips, zones), "plain_write")
    out, seen = observed_etl(trips, zones)
    # The counted lookup is not shared with the other join: its broadcast is one more job.
    assert jobs(out, "observed_write") <= plain + 1
    counts = etl_counts(seen)
    assert counts["n_raw"] == trips.count() and counts["n_kept"] == etl_transform(trips, zones).count() and counts["n_zones"] == zones.count()
    alone, seen = observed_etl(trips, None)
    alone.write.format("noop").mode("overwrite").save()
    assert "n_zones" not in etl_counts(seen) and etl_counts(seen)["n_kept"] == counts["n_kept"]


def test_cells_nest_and_touch(spark):
    rng = np.random.default_rng(3)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200))]
    points += [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (40.7, -74.0), (40.7, 286.0)]
    df = spark.createDataFrame(points, "lat double, lon double").withColumn("c", cell(F.col("lat"), F.col("lon"), 9))
    df = df.withColumns({"p": cell_parent(F.col("c"), 3), "path": cell_path(F.col("c")), "around": cell_neighbours(F.col("c"), 9), "r": cell_resolution(F.col("c"))})
    df = df.withColumns({"up": cell(F.col("lat"), F.col("lon"), 6), "inside": cell_contains(F.col("p"), F.col("c")), "back": cell_contains(F.col("c"), F.col("p")),
                         "child": F.array_contains(cell_children(cell_parent(F.col("c"))), F.col("c")), "p_path": cell_path(F.col("p"))})
    rows = df.collect()
    for r in rows:
        assert r.p == r.up and r.r == 9 and len(r.path) == 9 and r.path.startswith(r.p_path) and r.inside and not r.back and r.child
        x = int("".join(str(int(d) % 2) for d in r.path), 2)
        y = int("".join(str(int(d) // 2) for d in r.path), 2)
        assert x == int(((r.lon + 180) / 360 * 512) // 1) % 512 and y == min(511, int((r.lat + 90) / 180 * 512))
        want = {((x + i) % 512, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= y + j < 512}
        code = lambda x, y: (1 << 18) | sum(((x >> b & 1) | (y >> b & 1) << 1) << 2 * b for b in range(9))
        assert r.around == sorted(code(*w) for w in want)
    assert rows[-1].c == rows[-2].c
    odd = spark.createDataFrame([(None, 1.0), (91.0, 0.0), (float("nan"), 0.0), (1.0, None)], "lat double, lon double")
    assert [r[0] for r in odd.select(cell(F.col("lat"), F.col("lon"), 5)).collect()] == [None] * 4
    top = spark.range(1).select(cell(F.lit(1.0), F.lit(1.0), 0).alias("c")).select("c", cell_parent(F.col("c")), cell_path(F.col("c"))).first()
    assert tuple(top) == (1, None, "")


def test_sketches_merge_over_days(spark):
    from surgelane.operators.prep import prepare_features
    from surgelane.operators.quantiles import RANK_ERROR, daily_sketches, merged_quantiles, sketch_medians

    rng = np.random.default_rng(8)
    rows = [(dt.date(2024, 1, 1 + i % 9), float(v), None if i % 3 else float("nan")) for i, v in enumerate(rng.lognormal(size=20_000))]
    df = spark.createDataFrame(rows, "pickup_date date, a double, b double").repartition(7)
    sketches = daily_sketches(df, ["a", "b"])
    assert sorted(r.n for r in sketches.collect()) == sorted([20_000 // 9] * 7 + [20_000 // 9 + 1] * 2)
    values = np.sort([r[1] for r in rows if dt.date(2024, 1, 3) <= r[0] <= dt.date(2024, 1, 6)])
    for r in merged_quantiles(sketches, [0.05, 0.5, 0.95], "2024-01-03", "2024-01-06").collect():
        assert r.n == len(values) and abs(np.searchsorted(values, r.value) / len(values) - r.p) <= RANK_ERROR + 1 / len(values)
    table = spark.createDataFrame([(None, 1.0), (2.0, 1.0)], "a double, surge_multiplier double")
    out, _ = prepare_features(table, ["a"], medians=lambda wanted: sketch_medians(sketches, wanted))
    assert min(r.a for r in out.collect()) == pytest.approx(1.0, abs=0.05)


def test_range_run_reads_only_its_dates_and_the_state(spark):
    from surgelane.plans.etl import etl_transform
    from surgelane.plans.features import run_features, write_baseline_state
    from surgelane.sinks.tables import read_feature_table, write_partitioned
    from surgelane.sources.testdata import weather_from_events

    weather = weather_from_events(spark, SMOKE)
    processed = write_partitioned(etl_transform(trips_from_events(spark, SMOKE), zones_from_tables(spark, SMOKE)), scratch_path(spark, "processed_state"))
    state = scratch_path(spark, "baseline")
    full = run_features(spark, processed, weather, scratch_path(spark, "features_full"), baseline_path=state)
    whole = {tuple(r) for r in spark.read.parquet(state).where("_n > 0").collect()}
    only = run_features(spark, processed, weather, scratch_path(spark, "features_days"), "2024-01-10", "2024-01-12", state)
    assert {tuple(r) for r in spark.read.parquet(state).where("_n > 0").collect()} == whole
    want = [r for r in read_feature_table(spark, full).collect() if "2024-01-10" <= str(r.pickup_date) <= "2024-01-12"]
    assert sorted(map(repr, read_feature_table(spark, only).collect())) == sorted(map(repr, want))
    # A wrong state of one far day moves the baseline: it comes from the state alone.
    day = spark.read.parquet(state).where("pickup_date = '2024-01-17'").withColumn("_sx", F.col("_sx") * 1000)
    copy = scratch_path(spark, "baseline_copy")
    spark.read.parquet(state).where("pickup_date != '2024-01-17'").unionByName(day).write.partitionBy("pickup_date").parquet(copy)
    other = run_features(spark, processed, weather, scratch_path(spark, "features_other"), "2024-01-10", "2024-01-12", copy)
    assert sorted(map(repr, read_feature_table(spark, other).collect())) != sorted(map(repr, want))
    # Days that lost their trips count no longer.
    emptied = scratch_path(spark, "processed_less")
    spark.read.parquet(processed).where("pickup_date != '2024-01-11'").write.partitionBy("pickup_date", "hour").parquet(emptied)
    write_baseline_state(spark, emptied, state, "2024-01-10", "2024-01-12")
    assert spark.read.parquet(state).where("pickup_date = '2024-01-11' and _n > 0").count() == 0
