"""Phase A: raw trips -> quality -> calendar -> zones -> partitioned table."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from surgelane.config import FEATURES, QUALITY, RAW_COLUMNS, FeatureRules, QualityRules
from surgelane.operators.dimensions import add_placeholder_zones, enrich_zones, join_zones
from surgelane.operators.quality import apply_quality_filters, rule_violations
from surgelane.operators.temporal import extract_temporal_features
from surgelane.sinks.tables import stored_bytes, write_partitioned
from surgelane.sources.files import read_parquet, require_not_empty

log = logging.getLogger(__name__)


def etl_transform(
    trips: DataFrame,
    zones: DataFrame | None,
    quality: QualityRules = QUALITY,
    rules: FeatureRules = FEATURES,
) -> DataFrame:
    cleaned = apply_quality_filters(trips, quality)
    return enrich_zones(extract_temporal_features(cleaned, rules, quality), zones)


def observed_etl(
    trips: DataFrame, zones: DataFrame | None, quality: QualityRules = QUALITY, rules: FeatureRules = FEATURES
) -> tuple[DataFrame, dict[str, Observation]]:
    """``etl_transform`` that counts while it is written: raw rows and breaches of each rule, zones, kept rows.

    The counts are there once the action on the result ends; trips are read once.
    The zone table, small, is read once more, since its count belongs to one of its two joins.
    """
    seen = {name: Observation(name) for name in ("raw", "zones", "kept")}
    one = F.lit(1)
    broken = [F.count(F.when(c, one)).alias(name) for name, c in rule_violations(trips, quality).items()]
    raw = trips.observe(seen["raw"], F.count(one).alias("n_raw"), *broken)
    clean = extract_temporal_features(apply_quality_filters(raw, quality), rules, quality)
    if zones is None:
        del seen["zones"]
        out = add_placeholder_zones(clean)
    else:
        # The lookup is joined twice; one of the two counts it.
        out = join_zones(clean, zones, zones.observe(seen["zones"], F.count(one).alias("n_zones")))
    nulls = [F.count(F.when(F.col(c).isNull(), one)).alias(f"null_{c}") for c in ("passenger_count", "pickup_borough", "dropoff_borough")]
    return out.observe(seen["kept"], F.count(one).alias("n_kept"), *nulls), seen


def etl_counts(seen: dict[str, Observation]) -> dict[str, int]:
    return {name: int(n) for o in seen.values() for name, n in o.get.items()}


def run_etl(
    spark: SparkSession,
    raw_paths,
    out_path: str,
    zones: DataFrame | None = None,
    columns=RAW_COLUMNS,
) -> str:
    """The processed table; rows, breaches of each rule and bytes are counted by the write itself and logged."""
    trips = require_not_empty(read_parquet(spark, raw_paths, columns), "raw trips")
    out, seen = observed_etl(trips, zones)
    write_partitioned(out, out_path)
    log.info("etl %s, %d bytes in %s", etl_counts(seen), stored_bytes(spark, out_path), out_path)
    return out_path
