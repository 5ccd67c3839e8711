"""Adapter from the driver's test tables to the trip and zone contracts.

Only ``events.ts`` carries a time of day, so trips are derived from
``events``; zones come from ``nation`` joined to ``region``. Every expression
here is deterministic and has a one-to-one DuckDB form (see plans/oracles.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelane.sources.files import read_parquet

# Fixed values of the adapter contract.
PICKUP_ZONES = 27          # PULocationID = user_id % 27 + 1 (26, 27 have no zone)
DROPOFF_ZONES = 25         # DOLocationID = event_id % 25 + 1
DURATION_STEP = 37         # dropoff = ts + (event_id * 37 % 25000) seconds
DURATION_MOD = 25_000
SERVICE_ZONE = "Boro Zone"


def trips_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_parquet(spark, f"{sf_dir}/events.parquet", ["event_id", "ts", "user_id", "value"])
    return events_to_trips(ev)


def events_to_trips(ev: DataFrame) -> DataFrame:
    """Row-wise mapping (works on batch and streaming frames)."""
    secs = (F.col("event_id") * DURATION_STEP % DURATION_MOD).cast("decimal(18,6)")
    return ev.select(
        F.col("event_id").alias("trip_id"),
        F.col("ts").alias("tpep_pickup_datetime"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)).alias(
            "tpep_dropoff_datetime"
        ),
        F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("int"))
        .otherwise((F.col("event_id") % 11).cast("int"))
        .alias("passenger_count"),
        (F.col("value") / 5.0).alias("trip_distance"),
        (F.col("user_id") % PICKUP_ZONES + 1).cast("int").alias("PULocationID"),
        (F.col("event_id") % DROPOFF_ZONES + 1).cast("int").alias("DOLocationID"),
        (F.lit(2.5) + F.col("value") / 3.0).alias("fare_amount"),
        (F.col("value") - 1.0).alias("total_amount"),
    )


def zones_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Declared schemas: no job reads footers while the plan is built.
    nation = spark.read.schema("n_nationkey int, n_name string, n_regionkey int").parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.schema("r_regionkey int, r_name string").parquet(f"{sf_dir}/region.parquet")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
    return joined.select(
        (F.col("n_nationkey") + 1).cast("int").alias("LocationID"),
        F.col("r_name").alias("Borough"),
        F.col("n_name").alias("Zone"),
        F.lit(SERVICE_ZONE).alias("service_zone"),
    )


def weather_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather stand-in: one row per hour that has events, from their values.

    Sums, extremes and counts of the values in cents (whole numbers, so that any
    order of summation gives the same) are folded into the ranges of the four
    measurements; hours without events have no report.
    """
    from surgelane.operators.weather import classify_weather

    ev = read_parquet(spark, f"{sf_dir}/events.parquet", ["ts", "value"])
    cents = F.round(F.col("value") * 100).cast("long")
    hours = ev.groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents).alias("total"), F.min(cents).alias("least"), F.max(cents).alias("most")
    )
    wet = F.col("n") % 4 == 0
    return classify_weather(
        hours.select(
            "date",
            "hour",
            (F.lit(20.0) + F.col("total") % 700 / 10.0).alias("temperature_f"),
            F.when(wet, (F.col("most") % 50 + 1) / 100.0).otherwise(F.lit(0.0)).alias("precipitation_in"),
            (F.col("least") % 300 / 10.0).alias("wind_speed_mph"),
            (F.lit(1.0) + F.col("most") % 90 / 10.0).alias("visibility_miles"),
        )
    )
