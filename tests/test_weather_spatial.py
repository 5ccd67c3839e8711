"""Weather spine/classification/join, derived features, spatial cells."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import edge_trips, plan_text, trip
from surgelane.operators.derived import add_derived_features
from surgelane.operators.spatial import add_pseudo_coordinates, add_spatial_index
from surgelane.operators.supply import surge_features
from surgelane.operators.weather import classify_weather, integrate_weather, year_spine
from surgelane.plans.flagship import clean_trips


def test_year_spine(spark):
    spine = year_spine(spark, 2024)
    row = spine.agg(F.count("*"), F.countDistinct("hour"), F.countDistinct(F.month("date")), F.min("date"), F.max("date")).first()
    assert row[0] == 8784 and row[1] == 24 and row[2] == 12
    assert str(row[3]) == "2024-01-01" and str(row[4]) == "2024-12-31"


@pytest.mark.parametrize(
    "precip,temp,vis,expected",
    [(0.0, 60.0, 9.0, "Clear"), (0.2, 60.0, 6.0, "Rain"), (0.2, 34.9, 6.0, "Snow"),
     (0.2, 35.0, 6.0, "Rain"), (0.0, 60.0, 2.9, "Fog"), (0.0, 60.0, 3.0, "Clear")],
)
def test_classification(spark, precip, temp, vis, expected):
    df = spark.createDataFrame([(precip, temp, vis)], "precipitation_in double, temperature_f double, visibility_miles double")
    assert classify_weather(df).first().weather_condition == expected


def _weather(spark):
    return spark.createDataFrame(
        [("2024-02-05", 7, 41.0, 0.2, 12.0, 6.0, "Rain"), ("2024-02-05", 19, 43.0, 0.0, 10.0, 9.5, "Clear")],
        "date string, hour int, temperature_f double, precipitation_in double, wind_speed_mph double, "
        "visibility_miles double, weather_condition string",
    ).withColumn("date", F.col("date").cast("timestamp"))  # a timestamp-typed date still joins


def test_weather_join_defaults_and_onehot(spark, sample_trips):
    out = integrate_weather(clean_trips(sample_trips), _weather(spark))
    rows = {r.hour: r for r in out.collect()}
    assert (rows[7].temperature_f, rows[7].weather_is_rain, rows[7].weather_is_clear) == (41.0, 1, 0)
    assert (rows[19].weather_is_clear, rows[19].weather_is_rain) == (1, 0)
    unmatched = rows[16]
    assert (unmatched.temperature_f, unmatched.precipitation_in, unmatched.wind_speed_mph,
            unmatched.visibility_miles) == (55.0, 0.0, 8.0, 10.0)
    assert (unmatched.weather_is_clear, unmatched.weather_is_rain, unmatched.weather_is_snow,
            unmatched.weather_is_fog) == (0, 0, 0, 0)
    assert out.count() == 4


def test_derived_goldens(sample_trips):
    out = add_derived_features(surge_features(clean_trips(sample_trips))).orderBy("tpep_pickup_datetime").collect()
    got = [(round(r.fare_per_mile, 6), round(r.fare_per_minute, 6), round(r.speed_mph, 2), r.congestion_indicator,
            r.demand_acceleration, r.demand_trend) for r in out]
    assert got == [
        (4.5, 0.75, 10.0, 0, 1.0, 0),
        (4.0, 0.4, 6.0, 1, 1.0, 0),
        (3.0, 2.25, 45.0, 0, 1.0, 0),
        (5.625, 0.75, 8.0, 1, 1.0, 0),
    ]


def test_speed_cap_and_guards(spark):
    rows = [trip("2024-05-01 10:00:00", "2024-05-01 10:01:00", dist=150.0, trip_id=1)]  # 9000 mph
    out = add_derived_features(surge_features(clean_trips(edge_trips(spark, rows)))).first()
    assert out.speed_mph == 100.0 and out.congestion_indicator == 0


def test_spatial_fallback_and_hex(sample_trips):
    fb = add_spatial_index(sample_trips).select("PULocationID", "h3_pickup_index").collect()
    assert all(r.h3_pickup_index == f"loc_{r.PULocationID}" for r in fb)
    hexed = add_spatial_index(sample_trips, "pseudo_hex")
    assert hexed.columns[-2:] == ["h3_pickup_index", "h3_dropoff_index"]
    a = {r.PULocationID: r.h3_pickup_index for r in hexed.collect()}
    b = {r.PULocationID: r.h3_pickup_index for r in add_spatial_index(sample_trips, "pseudo_hex").collect()}
    assert a == b and all(v.startswith("hx_") for v in a.values())
    assert "BatchEvalPython" not in plan_text(hexed, "simple") and "ArrowEvalPython" not in plan_text(hexed, "simple")


def test_coordinates_dispatch(spark):
    df = spark.createDataFrame(
        [(40.7580, -73.9855, 40.7580, -73.9855), (40.7585, -73.9850, None, -73.9)],
        "pickup_latitude double, pickup_longitude double, dropoff_latitude double, dropoff_longitude double",
    )
    out = add_spatial_index(df).collect()
    assert out[0].h3_pickup_index == out[1].h3_pickup_index  # ~70 m apart: same cell
    assert out[1].h3_dropoff_index is None


def test_pseudo_coordinates(spark):
    df = spark.createDataFrame([(1, 0), (265, None)], "PULocationID int, DOLocationID int")
    rows = add_pseudo_coordinates(df).collect()
    assert 40.4774 <= rows[0].pickup_latitude <= 40.9176 and -74.2591 <= rows[0].pickup_longitude <= -73.7004
    assert rows[0].dropoff_latitude is None and rows[1].dropoff_longitude is None
    # Quirk kept on purpose: both fractions sum to one, ids fall on one diagonal.
    frac = (rows[0].pickup_latitude - 40.4774) / (40.9176 - 40.4774) + (rows[0].pickup_longitude + 74.2591) / (-73.7004 + 74.2591)
    assert abs(frac - 1.0) < 1e-9


def test_pandas_nanos_weather_file(spark, sample_trips, tmp_path):
    import pandas as pd

    from surgelane.sources.files import read_weather

    path = str(tmp_path / "w.parquet")
    pd.DataFrame({
        "date": pd.to_datetime(["2024-02-05", "2024-02-05"]).astype("datetime64[ns]"), "hour": [7, 19],
        "temperature_f": [41.0, 43.0], "precipitation_in": [0.2, 0.0], "wind_speed_mph": [12.0, 10.0],
        "visibility_miles": [6.0, 9.5], "weather_condition": ["Rain", "Clear"],
    }).astype({"hour": "int32"}).to_parquet(path, index=False)
    w = read_weather(spark, path, nanos_date=True)
    assert dict(w.dtypes)["date"] == "date" and dict(w.dtypes)["hour"] == "int"
    out = {r.hour: r for r in integrate_weather(clean_trips(sample_trips), w).collect()}
    assert out[7].weather_is_rain == 1 and out[19].weather_is_clear == 1
    assert spark.conf.get("spark.sql.legacy.parquet.nanosAsLong") == "false"


def test_weather_table_roundtrip(spark):
    from surgelane.session import scratch_path
    from surgelane.sinks.tables import write_weather_table
    from surgelane.sources.files import read_weather

    w = year_spine(spark, 2024).select(F.col("hour_ts").alias("date"), "hour", F.lit(50.0).alias("temperature_f"))
    path = write_weather_table(w, scratch_path(spark, "weather_out"))
    back = read_weather(spark, path)
    assert dict(back.dtypes)["date"] == "date" and back.count() == 8784


def test_missing_input_path_fails(spark):
    from pyspark.errors import AnalysisException

    from surgelane.sources.files import read_parquet

    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_parquet(spark, "/root/testdata/does-not-exist.parquet")
