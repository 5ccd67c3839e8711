"""Dimension lookups: joins to tables with checked unique keys, and the zone enrichment."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgelane.config import DO_LOC, PU_LOC

log = logging.getLogger(__name__)


class DuplicateDimensionKey(ValueError):
    """A lookup key occurs twice: a left join would silently multiply rows."""


def unique_side(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``dim`` with the promise, checked while the query runs, that no key repeats.

    Rows are grouped by key and counted; reading the first key column of a group
    of several rows fails the query. Rows with a NULL key part can never match an
    equi-join and are left out.
    """
    keys = list(keys)
    rest = [c for c in dim.columns if c not in keys]
    for k in keys:
        dim = dim.where(F.col(k).isNotNull())
    grouped = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    kind = dict(dim.dtypes)[keys[0]]
    message = F.concat(F.lit(f"{DuplicateDimensionKey.__name__}: lookup key {keys} repeats "), F.col("_n").cast("string"), F.lit(" times"))
    checked = F.when(F.col("_n") == 1, F.col(keys[0])).otherwise(F.raise_error(message).cast(kind))
    return grouped.select(checked.alias(keys[0]), *keys[1:], *rest)


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str] | None = None,
    how: str = "left",
) -> DataFrame:
    """Left (or inner) equi-join to a lookup table that must have unique keys.

    No job runs while the plan is built: uniqueness is checked in the plan, and
    Spark broadcasts the side by its own size threshold, from file sizes or, under
    adaptive execution, from the size that the side turned out to have. With
    equal key names this is a USING join (keys appear once); otherwise the
    dimension's key columns are dropped after the join.
    """
    right_on = list(right_on or left_on)
    left_on = list(left_on)
    side = unique_side(dim, right_on)
    if left_on == right_on:
        return fact.join(side, on=left_on, how=how)
    clash = set(right_on) & set(fact.columns)
    if clash:
        raise ValueError(f"rename dimension keys {sorted(clash)} before joining")
    cond = None
    for l, r in zip(left_on, right_on):
        c = F.col(l) == F.col(r)
        cond = c if cond is None else cond & c
    return fact.join(side, on=cond, how=how).drop(*right_on)


# ---------------------------------------------------------------------------
# Zone lookup for both trip endpoints (role-playing dimension).
# ---------------------------------------------------------------------------

def _zone_side(zones: DataFrame, prefix: str, key: str) -> DataFrame:
    return zones.select(
        F.col("LocationID").alias(key),
        F.col("Borough").alias(f"{prefix}_borough"),
        F.col("Zone").alias(f"{prefix}_zone"),
        F.col("service_zone").alias(f"{prefix}_service_zone"),
    )


def join_zones(trips: DataFrame, zones: DataFrame, dropoff_zones: DataFrame | None = None) -> DataFrame:
    """Add pickup_/dropoff_ borough, zone and service_zone (left joins)."""
    sides = (zones, zones if dropoff_zones is None else dropoff_zones)
    out = trips
    for prefix, loc, key, side in (("pickup", PU_LOC, "_pu_zone_id", sides[0]), ("dropoff", DO_LOC, "_do_zone_id", sides[1])):
        out = join_dimension(out, _zone_side(side, prefix, key), left_on=[loc], right_on=[key], how="left")
    return out


def add_placeholder_zones(trips: DataFrame) -> DataFrame:
    """Zone columns when no lookup table exists: Unknown / 'Zone_<id>'."""
    unknown = F.lit("Unknown")
    return trips.withColumns(
        {
            "pickup_borough": unknown,
            "pickup_zone": F.concat(F.lit("Zone_"), F.col(PU_LOC).cast("string")),
            "pickup_service_zone": unknown,
            "dropoff_borough": unknown,
            "dropoff_zone": F.concat(F.lit("Zone_"), F.col(DO_LOC).cast("string")),
            "dropoff_service_zone": unknown,
        }
    )


def enrich_zones(trips: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Zone join when a lookup exists, placeholder zones otherwise."""
    if zones is None:
        log.warning("no zone lookup: using placeholder zones")
        return add_placeholder_zones(trips)
    return join_zones(trips, zones)
