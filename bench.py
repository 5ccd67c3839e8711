"""Headline-query benchmark: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3, median reported). Every query is executed in full with
a no-op sink (no collect), after one warm-up pass over all of them.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dataclasses import replace  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from surgelane.config import BOOST, TARGET  # noqa: E402
from surgelane.operators.boost import expectile, train_boosted  # noqa: E402
from surgelane.operators.demand import rolling_demand  # noqa: E402
from surgelane.operators.prep import prepare_features, train_val_split  # noqa: E402
from surgelane.operators.supply import compute_supply_and_surge, surge_features  # noqa: E402
from surgelane.plans.etl import etl_transform  # noqa: E402
from surgelane.plans.features import feature_table, feature_transform  # noqa: E402
from surgelane.plans.flagship import clean_trips, surge_by_borough_hour  # noqa: E402
from surgelane.session import build_session, scratch_path  # noqa: E402
from surgelane.sources.testdata import trips_from_events, weather_from_events, zones_from_tables  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]",
        app_name="surgelane-bench",
        shuffle_partitions=cpus,
        checkpoint_dir=tempfile.mkdtemp(prefix="surgelane-bench-ckpt-", dir="/tmp"),
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    trips = lambda: trips_from_events(spark, sf_dir)
    zones = lambda: zones_from_tables(spark, sf_dir)
    clean = lambda: clean_trips(trips())
    weather = lambda: weather_from_events(spark, sf_dir)

    # Phase C reads the written feature table (as the pipeline does); write it
    # once, untimed.
    feat_path = scratch_path(spark, "bench_features")
    feature_transform(clean(), weather()).write.mode("overwrite").parquet(feat_path)
    features = lambda: spark.read.parquet(feat_path)

    def model_prep():
        prepared, _ = prepare_features(features(), keep=["trip_id"])
        return train_val_split(prepared, key="trip_id")

    def boost_5_rounds():
        prepared, names = prepare_features(features(), keep=["trip_id"])
        split = train_val_split(prepared, key="trip_id")
        train_boosted(split, names, TARGET, "is_validation", replace(BOOST, n_rounds=5), early_stopping=False)
        return None

    def base_score():
        prepared, _ = prepare_features(features(), keep=["trip_id"])
        split = train_val_split(prepared, key="trip_id")
        expectile(split.where("not is_validation"), TARGET, BOOST.underestimation_penalty)
        return None

    headline = {
        "flagship": lambda: surge_by_borough_hour(trips(), zones()),
        "etl": lambda: etl_transform(trips(), zones()),
        "rolling_demand": lambda: rolling_demand(clean()),
        "supply_window": lambda: surge_features(clean()),
        "supply_joinback": lambda: compute_supply_and_surge(rolling_demand(clean())),
        "feature_table": lambda: feature_table(clean(), weather()),
        "model_prep": model_prep,
        "base_score": base_score,
        "boost_5_rounds": boost_5_rounds,
    }

    def run(build):
        t0 = time.perf_counter()
        df = build()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    # Warm-up: every query once (JIT, file listings), then timed runs.
    for build in headline.values():
        run(build)
    timings = {}
    for name, build in headline.items():
        timings[name] = round(statistics.median(run(build) for _ in range(runs)), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf.group(1)) if sf else sf_dir,
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
