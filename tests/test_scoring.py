"""Batch scenario scoring and bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from surgelane.config import MODEL_FEATURES
from surgelane.operators.scoring import add_bands, align_features, linear_surge, scenario_features, score_scenarios


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.19, 1.2, 2.0, 2.01, 5.0, 4.5, 1.5, 2.5)], "s double")
    out = {r.s: (r.surge_band, r.gauge_band, r.surge_alert) for r in add_bands(df, "s").collect()}
    assert [out[v][0] for v in (1.0, 1.19, 1.2, 2.0, 2.01, 5.0)] == ["Low", "Low", "Moderate", "Moderate", "High", "High"]
    assert (out[1.0][1], out[1.5][1], out[2.5][1], out[5.0][1]) == ("green", "yellow", "red", "red")
    assert out[4.5][2] == 1 and out[2.5][2] == 0


def test_scenario_features(spark):
    df = spark.createDataFrame([(150.0, 0.5, 9, 2), (100.0, 0.1, 20, 7)],
                               "demand_60min double, precipitation_in double, hour int, day_of_week int")
    rows = scenario_features(df).collect()
    assert rows[0].demand_zscore == 0.75 and rows[0].weather_is_rain == 1 and rows[0].is_rush_hour == 1
    assert rows[0].is_weekend == 0
    assert rows[1].weather_is_rain == 0 and rows[1].is_rush_hour == 0 and rows[1].is_weekend == 1


def test_align(spark):
    df = spark.createDataFrame([(150.0, 2.0, 0.5, None)], "demand_60min double, temp double, precip double, hour int")
    out = align_features(df, ["hour", "demand_60min", "is_rush_hour"])
    assert out.columns == ["hour", "demand_60min", "is_rush_hour"]
    assert tuple(out.first()) == (0.0, 150.0, 0.0)


def test_score_floor(spark):
    df = spark.createDataFrame([(1, 10.0, 50.0, 3, 2, 0.0), (2, 300.0, 50.0, 8, 3, 0.5)],
                               "id int, demand_60min double, supply_baseline double, hour int, day_of_week int, precipitation_in double")
    out = {r.id: r for r in score_scenarios(df, linear_surge, MODEL_FEATURES, keep=["id"]).collect()}
    assert out[1].predicted_surge == 1.0 and out[1].surge_band == "Low"
    assert abs(out[2].predicted_surge - (0.5 + 0.4 * 6 + 0.1 + 0.05)) < 1e-12 and out[2].surge_band == "High"


def test_two_decimals_match_python(spark):
    from surgelane.operators.scoring import two_decimals

    values = [-2.925, 0.125, 2.945, 1.005, 1234.567, 0.0, -0.004, 2.675, 1.115]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in df.select(two_decimals(F.col("v")).alias("t")).collect()]
    assert got == ["{:.2f}".format(v) for v in values]


def test_scenario_report(spark):
    from surgelane.operators.scoring import scenario_report

    df = spark.createDataFrame([(1.5, 0.75, 1, 0, 1)],
                               "predicted_surge double, demand_zscore double, is_rush_hour int, is_weekend int, weather_is_rain int")
    r = scenario_report(df).first()
    assert (r.surge_text, r.zscore_text, r.rush_hour_text, r.weekend_text, r.raining_text) == ("1.50x", "0.75", "Yes", "No", "Yes")
