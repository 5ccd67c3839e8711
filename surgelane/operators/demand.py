"""Rolling demand: trips at the same pickup location in the trailing 15/30/60
minutes, current second and its peers included (W0-W3).

Trips are collapsed to (location, second) counts with a map-side partial
aggregate; the range windows run over the collapsed rows, partitioned by
(location, time chunk), with the trailing window of each chunk copied into the
next chunk as context rows. A window task then holds at most ``chunk_seconds +
max_window`` rows per location whatever the skew, and the per-trip columns come
back through one equi-join on (location, second).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgelane.config import FEATURES, PICKUP_TS, PU_LOC, FeatureRules
from surgelane.functions.common import epoch_seconds

UNIX_TS = "pickup_unix_ts"
TRIPS_AT_SECOND = "trips_at_second"


def demand_col(minutes: int) -> str:
    return f"demand_{minutes}min"


def demand_profile(
    df: DataFrame,
    rules: FeatureRules = FEATURES,
    loc: str = PU_LOC,
    ts: str = PICKUP_TS,
    carry: Sequence[str] = (),
    chunk_seconds: int | None = None,
) -> DataFrame:
    """Collapsed (location, second) table with trip counts and rolling demand.

    ``carry`` names columns that are functions of the second (e.g. hour,
    day_of_week) and should ride along. Output columns: loc, pickup_unix_ts,
    *carry, trips_at_second, demand_<m>min...
    """
    chunk = int(chunk_seconds or rules.demand_chunk_seconds)
    longest = 60 * max(rules.rolling_minutes)
    if chunk < longest:
        raise ValueError("chunk_seconds must cover the longest rolling window")

    per_second = (
        df.withColumn(UNIX_TS, epoch_seconds(ts))
        .groupBy(loc, UNIX_TS, *carry)
        .agg(F.count(F.lit(1)).alias(TRIPS_AT_SECOND))
    )
    s = F.col(UNIX_TS)
    home = F.floor(s / chunk)
    # Rows in the last `longest` seconds of a chunk are context for the next one.
    spill = (s - home * chunk) >= (chunk - longest)
    copies = F.array_compact(
        F.array(
            F.struct(home.alias("_chunk"), F.lit(False).alias("_ctx")),
            F.when(spill, F.struct((home + 1).alias("_chunk"), F.lit(True).alias("_ctx"))),
        )
    )
    expanded = per_second.select("*", F.inline(copies))
    spec = Window.partitionBy(loc, "_chunk").orderBy(UNIX_TS)
    windows = {
        demand_col(m): F.sum(TRIPS_AT_SECOND).over(spec.rangeBetween(-60 * m, 0))
        for m in rules.rolling_minutes
    }
    return (
        expanded.withColumns(windows)
        .filter(~F.col("_ctx"))
        .drop("_chunk", "_ctx")
    )


def attach_by_second(
    trips: DataFrame,
    profile: DataFrame,
    columns: Sequence[str],
    loc: str = PU_LOC,
    ts: str = PICKUP_TS,
) -> DataFrame:
    """Join per-(location, second) columns back to trips (NULL-safe on location).

    Every trip has exactly one profile row, so the join preserves row count.
    The profile grows with the data (no size bound): the hint keeps it from
    being broadcast on an estimate and lets both sides spill. AQE splits a hot
    key on the trip side.
    """
    right = profile.select(
        F.col(loc).alias("_p_loc"), F.col(UNIX_TS).alias("_p_sec"), *[F.col(c) for c in columns]
    ).hint("merge")
    left = trips.withColumn(UNIX_TS, epoch_seconds(ts))
    cond = left[loc].eqNullSafe(right["_p_loc"]) & (left[UNIX_TS] == right["_p_sec"])
    return left.join(right, cond, "inner").drop("_p_loc", "_p_sec")


def rolling_demand(
    df: DataFrame,
    rules: FeatureRules = FEATURES,
    loc: str = PU_LOC,
    ts: str = PICKUP_TS,
) -> DataFrame:
    """Add pickup_unix_ts and demand_15/30/60min to every trip."""
    prof = demand_profile(df, rules, loc, ts)
    return attach_by_second(df, prof, [demand_col(m) for m in rules.rolling_minutes], loc, ts)
