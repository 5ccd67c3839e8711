"""Phase runner (X1): ``spark-submit -m surgelane.plans.jobs --phases etl,features,model``.

Each phase reads a table, transforms it and writes a table, so a run can
restart from the last written phase (``--skip-*`` / ``--only-*``). Spark
settings come from spark-submit; nothing here sizes the cluster.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession

from surgelane.config import BOOST
from surgelane.operators.boost import BoostedTrees
from surgelane.plans.etl import run_etl
from surgelane.plans.features import run_features
from surgelane.plans.model import save_artifacts, train_surge_model
from surgelane.session import build_session
from surgelane.sinks.tables import read_feature_table
from surgelane.sources.files import read_weather, read_zone_csv, require_not_empty

PHASES = ("etl", "features", "model")

log = logging.getLogger("surgelane.jobs")


def select_phases(args: argparse.Namespace) -> list[str]:
    only = [p for p in PHASES if getattr(args, f"only_{p}")]
    if only:
        return only
    chosen = [p.strip() for p in args.phases.split(",") if p.strip()]
    return [p for p in PHASES if p in chosen and not getattr(args, f"skip_{p}")]


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    done: dict[str, str] = {}
    for phase in select_phases(args):
        if phase == "etl":
            zones = read_zone_csv(spark, args.zones) if args.zones else None
            done[phase] = run_etl(spark, args.raw, args.processed, zones)
        elif phase == "features":
            weather = read_weather(spark, args.weather)
            done[phase] = run_features(
                spark, args.processed, weather, args.features, args.date_from, args.date_to, args.baseline
            )
        elif phase == "model":
            feats = require_not_empty(read_feature_table(spark, args.features), args.features)
            params = BOOST
            if args.rounds is not None:
                params = replace(params, n_rounds=args.rounds)
            if args.learning_rate is not None:
                params = replace(params, learning_rate=args.learning_rate)
            result = train_surge_model(
                feats, key=args.key, params=params, incremental=args.incremental,
                exclude=tuple(args.exclude.split(",")) if args.exclude else (),
                init_model=BoostedTrees.load(spark, f"{args.init_model}/model") if args.init_model else None,
                folder=args.run_dir,
            )
            done[phase] = save_artifacts(spark, result, args.model_dir)
        log.info("phase %s -> %s", phase, done[phase])
    return done


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="surge pipeline phases")
    p.add_argument("--phases", default=",".join(PHASES))
    for ph in PHASES:
        p.add_argument(f"--skip-{ph}", action="store_true")
        p.add_argument(f"--only-{ph}", action="store_true")
    p.add_argument("--raw", help="raw trip Parquet path or glob")
    p.add_argument("--zones", help="zone lookup CSV (optional: placeholders without it)")
    p.add_argument("--weather", help="hourly weather Parquet")
    p.add_argument("--processed", required=True, help="partitioned processed table")
    p.add_argument("--features", required=True, help="feature table")
    p.add_argument("--model-dir", dest="model_dir", required=True)
    p.add_argument("--key", default=None, help="row key column for the split")
    p.add_argument("--exclude", default="", help="comma-separated features to leave out")
    p.add_argument("--incremental", action="store_true", help="warm-start batches")
    p.add_argument("--date-from", dest="date_from", default=None,
                   help="features for pickups from this date (partition-pruned; other dates of the table stay)")
    p.add_argument("--date-to", dest="date_to", default=None, help="features for pickups up to this date")
    p.add_argument("--baseline", default=None, help="supply baseline state by date: kept up to date by each run, read by date ranges instead of the whole table")
    p.add_argument("--rounds", type=int, default=None, help="boosting rounds (default from config)")
    p.add_argument("--init-model", dest="init_model", default=None, help="model folder of an earlier run, boosted further")
    p.add_argument("--run-dir", dest="run_dir", default=None, help="shared folder of this training run's checkpoints; a repeated run goes on from the last one")
    p.add_argument("--learning-rate", dest="learning_rate", type=float, default=None)
    return p


def main(argv=None) -> None:
    logging.basicConfig(level=logging.INFO)
    args = parser().parse_args(argv)
    run(build_session(app_name="surgelane-jobs"), args)


if __name__ == "__main__":
    main()
