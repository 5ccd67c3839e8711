"""Print the formatted physical plan of headline queries.

usage: python tools/explain_plans.py [sf_dir] [name ...]
Useful to confirm PushedFilters/ReadSchema on scans, the join strategies
(checked broadcasts for dimensions, shuffled hash join for the per-second
join-back), one trip scan per profile and no Python evaluation nodes.
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from surgelane.plans.features import feature_table  # noqa: E402
from surgelane.plans.flagship import clean_trips, surge_by_borough_hour  # noqa: E402
from surgelane.operators.supply import surge_features  # noqa: E402
from surgelane.session import build_session  # noqa: E402
from surgelane.sources.testdata import trips_from_events, weather_from_events, zones_from_tables  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", shuffle_partitions=8,
                          checkpoint_dir=tempfile.mkdtemp(prefix="ck-", dir="/tmp"),
                          extra={"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    trips = trips_from_events(spark, sf_dir)
    plans = {
        "flagship": lambda: surge_by_borough_hour(trips, zones_from_tables(spark, sf_dir)),
        "surge_features": lambda: surge_features(clean_trips(trips)),
        "feature_table": lambda: feature_table(clean_trips(trips), weather_from_events(spark, sf_dir)),
    }
    for name, build in plans.items():
        if names and name not in names:
            continue
        print(f"===== {name} =====")
        build().explain("formatted")


if __name__ == "__main__":
    main()
