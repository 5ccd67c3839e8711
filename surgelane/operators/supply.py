"""Supply baseline, surge multiplier and demand z-score.

The baseline is the mean of demand_60min over all trips sharing
(PULocationID, hour, day_of_week) — over the whole input, as the reference
computes it — with the sample standard deviation and trip count. With
``lookback_days`` only the previous N days of the same key count.

``surge_profile`` / ``surge_features`` compute it from the collapsed
(location, second) rows; ``supply_baseline`` / ``compute_supply_and_surge``
are the per-trip forms kept for comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgelane.config import FEATURES, PICKUP_TS, PU_LOC, FeatureRules
from surgelane.functions.common import epoch_seconds
from surgelane.operators.demand import (
    TRIPS_AT_SECOND,
    UNIX_TS,
    attach_by_second,
    demand_col,
    demand_profile,
)
from surgelane.sinks.tables import write_bucketed

SUPPLY_KEYS = (PU_LOC, "hour", "day_of_week")
#: Stands for a missing location in the keys of bucketed tables; ids are never negative.
NO_LOCATION = -1
SUPPLY_COLUMNS = ("supply_baseline", "supply_stddev", "sample_count")


# ---------------------------------------------------------------------------
# Expressions
# ---------------------------------------------------------------------------

def repaired_baseline(baseline: Column) -> Column:
    """NULL or 0 baseline becomes 1.0 (no division by zero downstream)."""
    return F.when(baseline.isNull() | (baseline == 0), F.lit(1.0)).otherwise(baseline)


def surge_expr(demand: Column, baseline: Column, rules: FeatureRules = FEATURES) -> Column:
    """demand / baseline clamped to [min_surge, max_surge] (NULL stays NULL)."""
    raw = demand / baseline
    clamped = F.greatest(F.lit(rules.min_surge), F.least(F.lit(rules.max_surge), raw))
    return F.when(raw.isNotNull(), clamped)


def zscore_expr(demand: Column, baseline: Column, stddev: Column) -> Column:
    """(demand - baseline) / stddev when stddev > 0, else 0.0."""
    return F.when(stddev.isNotNull() & (stddev > 0), (demand - baseline) / stddev).otherwise(
        F.lit(0.0)
    )


def weighted_stats(value: Column, weight: Column) -> dict[str, Column]:
    """Aggregates for a mean and sample stddev of ``value`` repeated ``weight`` times.

    Sums are exact integers (bigint, decimal(38,0) for the square sum), so the
    result does not depend on partitioning or summation order.
    """
    return {
        "_n": F.sum(weight),
        "_sx": F.sum(weight * value),
        "_sxx": F.sum(weight.cast("decimal(20,0)") * value.cast("decimal(20,0)") * value),
    }


def aliased(exprs: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in exprs.items()]


def finish_stats(prefix: str = "supply") -> dict[str, Column]:
    n, sx, sxx = F.col("_n"), F.col("_sx"), F.col("_sxx")
    num = n.cast("decimal(38,0)") * sxx - sx.cast("decimal(38,0)") * sx
    var = F.when(n > 1, num.cast("double") / (n.cast("double") * (n - 1).cast("double")))
    return {
        f"{prefix}_baseline": sx.cast("double") / n.cast("double"),
        # greatest() skips NULL, so keep the one-row NULL explicitly.
        f"{prefix}_stddev": F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))),
        "sample_count": n,
    }


def _surge_columns(rules: FeatureRules) -> dict[str, Column]:
    d60 = F.col(demand_col(60))
    base = F.col("supply_baseline")
    return {
        "surge_multiplier_raw": d60 / base,
        "surge_multiplier": surge_expr(d60, base, rules),
        "demand_zscore": zscore_expr(d60, base, F.col("supply_stddev")),
    }


# ---------------------------------------------------------------------------
# Operators
# ---------------------------------------------------------------------------

def supply_baseline(df: DataFrame, keys: Sequence[str] = SUPPLY_KEYS) -> DataFrame:
    """GROUP BY keys: avg, sample stddev and count of demand_60min (per trip rows)."""
    d60 = F.col(demand_col(60))
    return df.groupBy(*keys).agg(
        F.avg(d60).alias("supply_baseline"),
        F.stddev_samp(d60).alias("supply_stddev"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def compute_supply_and_surge(
    df: DataFrame, rules: FeatureRules = FEATURES, keys: Sequence[str] = SUPPLY_KEYS
) -> DataFrame:
    """Trip-level form: baseline per key joined back (USING keys: NULL keys get
    no baseline, then 1.0), then surge and z-score.

    The baseline table (one row per location, hour and weekday seen) is broadcast
    only if it turns out to be below Spark's threshold: its estimate is that of
    the trips, which is never less. ``surge_profile`` avoids this join and the
    second evaluation of the trip lineage altogether.
    """
    joined = df.join(supply_baseline(df, keys), on=list(keys), how="left")
    return joined.withColumn("supply_baseline", repaired_baseline(F.col("supply_baseline"))).withColumns(
        _surge_columns(rules)
    )


def surge_profile(
    trips: DataFrame,
    rules: FeatureRules = FEATURES,
    keys: Sequence[str] = SUPPLY_KEYS,
    lookback_days: int | None = None,
    since: str | None = None,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """Collapsed (location, second) table with demand, baseline, surge, z-score.

    Trips must already carry hour and day_of_week. The baseline statistics are
    window sums over the collapsed rows (weighted by their trip count) in the
    partition (location, hour, day_of_week): the trip table is scanned once and
    the only extra shuffle moves collapsed rows, not trips. A partition holds
    at most one row per second of that weekly hour, whatever the skew: 3,600
    rows a week, 190,800 for the one year that the quality rules admit.

    ``since`` (ISO date) marks trips picked up earlier as context: they count in
    the rolling windows (and as lookback history), and their rows are flagged
    ``_in_scope = false``. A part of the input needs the ``baseline`` of the whole
    (``supply_from_profile``): it is then joined instead of computed.
    """
    loc = keys[0]
    carry = list(keys[1:]) + (["pickup_date"] if lookback_days or since else [])
    prof = demand_profile(trips, rules, loc=loc, carry=carry)
    scope = F.col("pickup_date") >= F.lit(since).cast("date") if since else F.lit(True)
    prof = prof.withColumn("_in_scope", scope)
    if baseline is not None:
        if lookback_days:
            raise ValueError("a lookback has its history in the input, not in a baseline table")
        # A NULL key finds no baseline, as in the whole-input form.
        out = prof.join(baseline.select(*keys, *SUPPLY_COLUMNS), on=list(keys), how="left")
        return out.withColumn("supply_baseline", repaired_baseline(F.col("supply_baseline"))).withColumns(
            _surge_columns(rules)
        )
    spec = Window.partitionBy(*keys)
    terms = _weighted_terms()
    if lookback_days:
        # Same key, the previous `lookback_days` calendar days only.
        spec = spec.orderBy(F.unix_date("pickup_date")).rangeBetween(-lookback_days, -1)
    elif since:
        raise ValueError("a date range needs the whole input's baseline table")
    sums = {name: F.sum(expr).over(spec) for name, expr in terms.items()}
    stats = finish_stats()
    # A NULL key never matches in the per-trip USING join: no baseline there.
    all_keys = F.lit(True)
    for k in keys:
        all_keys = all_keys & F.col(k).isNotNull()
    out = prof.withColumns(sums).withColumns(
        {name: F.when(all_keys, expr) for name, expr in stats.items()}
    )
    out = out.drop(*sums.keys())
    return out.withColumn("supply_baseline", repaired_baseline(F.col("supply_baseline"))).withColumns(
        _surge_columns(rules)
    )


def supply_from_profile(prof: DataFrame, keys: Sequence[str] = SUPPLY_KEYS) -> DataFrame:
    """Baseline table (one row per key) from collapsed rows weighted by their
    trip count; equal to ``supply_baseline`` over the trip rows."""
    n = F.col(TRIPS_AT_SECOND)
    d60 = F.col(demand_col(60))
    return (
        prof.groupBy(*keys)
        .agg(*aliased(weighted_stats(d60, n)))
        .select(*keys, *aliased(finish_stats()))
    )


def baseline_state(prof: DataFrame, keys: Sequence[str] = SUPPLY_KEYS, date_col: str = "pickup_date") -> DataFrame:
    """Mergeable baseline: count, sum and square sum of demand_60min per key and pickup date, from collapsed rows."""
    terms = weighted_stats(F.col(demand_col(60)), F.col(TRIPS_AT_SECOND))
    return prof.groupBy(*keys, date_col).agg(*aliased(terms))


def supply_from_state(state: DataFrame, keys: Sequence[str] = SUPPLY_KEYS) -> DataFrame:
    """Baseline table from the sums of all dates in the state; equal to ``supply_from_profile`` over their trips."""
    sums = state.where("_n > 0").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_n", "_sx", "_sxx")])
    return sums.select(*keys, *aliased(finish_stats()))


def _weighted_terms() -> dict[str, Column]:
    """Row terms whose sums give count, sum and square sum of demand_60min."""
    n = F.col(TRIPS_AT_SECOND)
    d60 = F.col(demand_col(60))
    return {
        "_n": n,
        "_sx": n * d60,
        "_sxx": n.cast("decimal(20,0)") * d60.cast("decimal(20,0)") * d60,
    }


def attach_bucketed(trips: DataFrame, profile: DataFrame, columns: Sequence[str], table: str, path: str, buckets: int | None = None) -> DataFrame:
    """``attach_by_second`` over a table of trips kept in buckets of (location, second).

    The trips are written once by that key; the join reads them bucket by bucket
    in order, and only the collapsed profile is shuffled, whichever features are
    attached, as often as wanted. A missing location is a key of its own.
    """
    key = F.coalesce(F.col(PU_LOC).cast("long"), F.lit(NO_LOCATION)).alias("_loc_key")
    stored = write_bucketed(trips.select("*", key, epoch_seconds(PICKUP_TS).alias(UNIX_TS)), table, ["_loc_key", UNIX_TS], path, buckets)
    right = profile.select(key, F.col(UNIX_TS), *columns).hint("merge")
    return stored.join(right, ["_loc_key", UNIX_TS]).select(*trips.columns, UNIX_TS, *columns)


def surge_features(
    trips: DataFrame,
    rules: FeatureRules = FEATURES,
    keys: Sequence[str] = SUPPLY_KEYS,
    lookback_days: int | None = None,
    since: str | None = None,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """Per-trip demand_*, supply_baseline, supply_stddev, sample_count,
    surge_multiplier(_raw) and demand_zscore via one join on (location, second).

    With ``since``, only trips from that date on are returned; earlier trips
    serve as rolling-window context (read one extra day before a date range).
    """
    prof = surge_profile(trips, rules, keys, lookback_days, since, baseline)
    if since:
        prof = prof.filter(F.col("_in_scope"))
        trips = trips.filter(F.col("pickup_date") >= F.lit(since).cast("date"))
    cols = [demand_col(m) for m in rules.rolling_minutes] + [
        "supply_baseline",
        "supply_stddev",
        "sample_count",
        "surge_multiplier_raw",
        "surge_multiplier",
        "demand_zscore",
    ]
    return attach_by_second(trips, prof, cols, loc=keys[0], ts=PICKUP_TS)
