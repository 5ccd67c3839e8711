"""Property-based: the skew-safe rolling demand equals the per-trip window on
random trips (NULL locations, peers, chunk boundaries), and the fused surge
path equals the reference-shaped join-back."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import direct_demand, edge_trips
from surgelane.config import FeatureRules
from surgelane.operators.demand import rolling_demand
from surgelane.operators.supply import compute_supply_and_surge, surge_features
from surgelane.plans.flagship import clean_trips

BASE = dt.datetime(2024, 3, 9, 22, 0, 0)  # crosses midnight (a chunk boundary)
COLS = ["demand_15min", "demand_30min", "demand_60min"]

trips_strategy = st.lists(
    st.tuples(st.integers(0, 4 * 3600), st.sampled_from([None, 1, 2, 3])),
    min_size=1,
    max_size=60,
)


def _rows(events):
    out = []
    for i, (off, loc) in enumerate(events):
        t = BASE + dt.timedelta(seconds=off)
        out.append((i, t.strftime("%Y-%m-%d %H:%M:%S"), (t + dt.timedelta(minutes=5)).strftime("%Y-%m-%d %H:%M:%S"),
                    1, 2.0, loc, 1, 10.0, 12.0))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events=trips_strategy, chunk=st.sampled_from([3600, 5400, 86400]))
def test_preagg_matches_direct(spark, events, chunk):
    df = clean_trips(edge_trips(spark, _rows(events)))
    rules = FeatureRules(demand_chunk_seconds=chunk)
    a = {r.trip_id: tuple(r[c] for c in COLS) for r in direct_demand(df, rules).collect()}
    b = {r.trip_id: tuple(r[c] for c in COLS) for r in rolling_demand(df, rules).collect()}
    assert a == b


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(events=trips_strategy)
def test_fused_matches_join_back(spark, events):
    df = clean_trips(edge_trips(spark, _rows(events)))
    cols = ["demand_60min", "supply_baseline", "surge_multiplier", "demand_zscore"]
    a = {r.trip_id: tuple(r[c] for c in cols) for r in surge_features(df).collect()}
    b = {r.trip_id: tuple(r[c] for c in cols)
         for r in compute_supply_and_surge(direct_demand(df)).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]
        for x, y in zip(a[k][1:], b[k][1:]):
            assert abs(x - y) < 1e-9
