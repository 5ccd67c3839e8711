"""Rolling demand, supply baseline, surge, z-score (phase B core)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, SMOKE, direct_demand, edge_trips, plan_text, trip
from surgelane.config import FEATURES, FeatureRules
from surgelane.operators.demand import demand_profile, rolling_demand
from surgelane.operators.supply import compute_supply_and_surge, surge_features, surge_profile
from surgelane.plans.flagship import clean_trips
from surgelane.sources.testdata import trips_from_events

DEMAND = ["demand_15min", "demand_30min", "demand_60min"]


def _by_id(df, cols):
    return {r["trip_id"]: tuple(r[c] for c in cols) for r in df.select("trip_id", *cols).collect()}


def test_window_edges(spark):
    times = {
        1: "12:00:00", 2: "12:00:00", 3: "11:45:00", 4: "11:44:59",
        5: "11:30:00", 6: "11:00:00", 7: "10:59:59",
    }
    rows = [trip(f"2024-05-01 {t}", "2024-05-01 13:30:00", pu=5, trip_id=i) for i, t in times.items()]
    rows.append(trip("2024-05-01 12:00:00", "2024-05-01 13:30:00", pu=6, trip_id=8))  # other location
    df = clean_trips(edge_trips(spark, rows))
    for demand in (direct_demand, rolling_demand):
        got = _by_id(demand(df), DEMAND)
        assert got[1] == got[2] == (3, 5, 6)
        assert got[3] == (3, 3, 5)
        assert got[7] == (1, 1, 1)
        assert got[8] == (1, 1, 1)


@pytest.mark.parametrize("chunk", [3600, 7200, 86400])
def test_preagg_equals_direct(spark, chunk):
    df = clean_trips(trips_from_events(spark, SMALL))
    rules = FeatureRules(demand_chunk_seconds=chunk)
    direct = direct_demand(df, rules).select("trip_id", *DEMAND)
    pre = rolling_demand(df, rules).select("trip_id", *DEMAND)
    assert direct.count() == pre.count() == df.count()
    assert direct.exceptAll(pre).count() == 0 and pre.exceptAll(direct).count() == 0


def test_hot_location(spark):
    """A third of all trips at one location: same counts, and the window is
    partitioned by (location, chunk), not by location alone."""
    base = clean_trips(trips_from_events(spark, SMALL))
    hot = base.withColumn(
        "PULocationID", F.when(F.col("trip_id") % 3 == 0, F.lit(1)).otherwise(F.col("PULocationID"))
    )
    direct = direct_demand(hot).select("trip_id", *DEMAND)
    pre = rolling_demand(hot).select("trip_id", *DEMAND)
    assert direct.exceptAll(pre).count() == 0
    plan = plan_text(demand_profile(hot), "simple")
    assert "hashpartitioning(PULocationID" in plan and "_chunk" in plan


def test_demand_invariants(spark):
    out = rolling_demand(clean_trips(trips_from_events(spark, SMOKE)))
    row = out.agg(
        F.min("demand_15min"),
        F.sum(((F.col("demand_60min") < F.col("demand_30min")) | (F.col("demand_30min") < F.col("demand_15min"))).cast("int")),
    ).first()
    assert row[0] >= 1 and row[1] == 0


def test_surge_above_one(spark):
    rows = [trip(f"2024-05-01 12:0{i}:00", "2024-05-01 12:30:00", pu=5, trip_id=i) for i in range(3)]
    out = _by_id(surge_features(clean_trips(edge_trips(spark, rows))),
                 ["demand_60min", "supply_baseline", "supply_stddev", "surge_multiplier", "demand_zscore"])
    assert out[0] == (1, 2.0, 1.0, 1.0, -1.0)
    assert out[1] == (2, 2.0, 1.0, 1.0, 0.0)
    assert out[2] == (3, 2.0, 1.0, 1.5, 1.0)


def test_fixture_surge_defaults(sample_trips):
    out = surge_features(clean_trips(sample_trips)).collect()
    assert len(out) == 4
    for r in out:
        assert (r.demand_15min, r.demand_30min, r.demand_60min) == (1, 1, 1)
        assert r.supply_baseline == 1.0 and r.supply_stddev is None
        assert r.demand_zscore == 0.0 and r.surge_multiplier == 1.0


def test_null_location_gets_default_baseline(spark):
    rows = [trip(f"2024-05-01 12:0{i}:00", "2024-05-01 12:30:00", pu=None, trip_id=i) for i in range(3)]
    out = surge_features(clean_trips(edge_trips(spark, rows))).orderBy("trip_id").collect()
    assert [r.demand_60min for r in out] == [1, 2, 3]          # NULL location is still one window group
    assert all(r.supply_baseline == 1.0 and r.demand_zscore == 0.0 for r in out)
    assert [r.surge_multiplier for r in out] == [1.0, 2.0, 3.0]
    ref = compute_supply_and_surge(direct_demand(clean_trips(edge_trips(spark, rows))))
    assert sorted(r.surge_multiplier for r in ref.collect()) == [1.0, 2.0, 3.0]


def test_fused_equals_join_back(spark):
    df = clean_trips(trips_from_events(spark, SMALL))
    cols = ["demand_60min", "supply_baseline", "supply_stddev", "sample_count", "surge_multiplier", "demand_zscore"]
    fused = _by_id(surge_features(df), cols)
    ref = _by_id(compute_supply_and_surge(direct_demand(df)), cols)
    assert fused.keys() == ref.keys()
    for k, a in fused.items():
        b = ref[k]
        assert a[0] == b[0] and a[3] == b[3]
        for x, y in zip(a[1:3] + a[4:], b[1:3] + b[4:]):
            assert (x is None and y is None) or abs(x - y) < 1e-9


def test_surge_invariants(spark):
    out = surge_features(clean_trips(trips_from_events(spark, SMALL)))
    row = out.agg(F.min("surge_multiplier"), F.max("surge_multiplier"), F.min("supply_baseline")).first()
    assert FEATURES.min_surge <= row[0] and row[1] <= FEATURES.max_surge and row[2] > 0


def test_profile_scans_trips_once(spark):
    prof = surge_profile(clean_trips(trips_from_events(spark, SMOKE)))
    assert plan_text(prof, "simple").count("FileScan parquet") == 1


def test_lookback_uses_previous_days_only(spark):
    # Same location, Wednesday 12:00 on three consecutive weeks.
    rows = [trip(f"2024-05-{d:02d} 12:00:00", "2024-05-01 12:30:00".replace("01", f"{d:02d}"), pu=5, trip_id=d)
            for d in (1, 8, 15)]
    rows.append(trip("2024-05-15 12:10:00", "2024-05-15 12:30:00", pu=5, trip_id=99))
    out = _by_id(surge_features(clean_trips(edge_trips(spark, rows)), lookback_days=28),
                 ["demand_60min", "supply_baseline"])
    assert out[1] == (1, 1.0)       # no history -> default
    assert out[8] == (1, 1.0)       # history: one trip with demand 1
    assert out[15] == (1, 1.0)
    assert out[99] == (2, 1.0)      # same-day trips are not history
