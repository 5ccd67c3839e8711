"""Shared fixtures: one local session, the 7-trip fixture, zones, edge rows."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"

# Own trips, from the rules: weekday morning and evening rush, a weekend night and
# a weekend rush hour are kept; the last three break one bound each.
# trip_id, pickup, dropoff, passengers, miles, from, to, fare, total
TRIP_ROWS = [
    (1, "2024-02-05 07:00:00", "2024-02-05 07:24:00", 1, 4.0, 3, 9, 18.0, 24.0),
    (2, "2024-02-05 19:30:00", "2024-02-05 20:00:00", 4, 3.0, 4, 3, 12.0, 15.0),
    (3, "2024-07-13 00:05:00", "2024-07-13 00:17:00", None, 9.0, 9, 7, 27.0, 30.5),
    (4, "2024-07-14 16:00:00", "2024-07-14 16:45:00", 2, 6.0, 7, 4, 33.75, 40.0),
    (5, "2024-02-05 07:00:00", "2024-02-05 07:24:00", 1, 0.05, 3, 9, 18.0, 24.0),
    (6, "2024-02-05 07:00:00", "2024-02-05 07:24:00", 0, 4.0, 3, 9, 18.0, 24.0),
    (7, "2024-02-05 07:00:00", "2024-02-05 07:24:00", 1, 4.0, 3, 9, 18.0, -1.0),
]

ZONE_ROWS = [
    (3, "North", "Harbour", "Inner"),
    (4, "North", "Market", "Inner"),
    (7, "South", "Airfield", "Outer"),
    (9, "South", "Old Mill", "Outer"),
]


@pytest.fixture(scope="session")
def spark():
    from surgelane.session import build_session, ship_package

    s = build_session(
        "local[*]",
        app_name="surgelane-tests",
        shuffle_partitions=8,
        checkpoint_dir=tempfile.mkdtemp(prefix="surgelane-test-ckpt-", dir="/tmp"),
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


def edge_trips(spark, rows):
    """Trips from compact rows (see ``trip``)."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, EDGE_SCHEMA)
    return df.withColumns(
        {
            "tpep_pickup_datetime": F.col("tpep_pickup_datetime").cast("timestamp_ntz"),
            "tpep_dropoff_datetime": F.col("tpep_dropoff_datetime").cast("timestamp_ntz"),
        }
    )


@pytest.fixture
def sample_trips(spark):
    return edge_trips(spark, TRIP_ROWS)


@pytest.fixture
def sample_zones(spark):
    from surgelane.sources.files import ZONE_SCHEMA

    return spark.createDataFrame(ZONE_ROWS, ZONE_SCHEMA)


def trip(pickup, dropoff, pu=1, do=2, pax=1, dist=2.0, fare=10.0, total=12.0, trip_id=None):
    """Compact trip row for edge-case fixtures."""
    return (trip_id, pickup, dropoff, pax, dist, pu, do, fare, total)


EDGE_SCHEMA = (
    "trip_id long, tpep_pickup_datetime string, tpep_dropoff_datetime string, passenger_count int, "
    "trip_distance double, PULocationID int, DOLocationID int, fare_amount double, total_amount double"
)


def direct_demand(df, rules=None):
    """Rolling demand as plain range windows per trip: what the operator must equal."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from surgelane.config import FEATURES
    from surgelane.functions.common import epoch_seconds
    from surgelane.operators.demand import demand_col

    spec = Window.partitionBy("PULocationID").orderBy("pickup_unix_ts")
    windows = {demand_col(m): F.count(F.lit(1)).over(spec.rangeBetween(-60 * m, 0)) for m in (rules or FEATURES).rolling_minutes}
    return df.withColumn("pickup_unix_ts", epoch_seconds("tpep_pickup_datetime")).withColumns(windows)


def plan_text(df, mode: str = "formatted") -> str:
    """The text of ``df.explain(mode)``."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()
