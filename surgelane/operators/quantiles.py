"""Mergeable quantiles (A2): a sketch per day and column, merged for any range of days.

Exact medians stay the default (``operators.prep.column_medians``); these serve
ranges of a long history without reading it, with a bounded error of the rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch: its ranks are off by less than RANK_ERROR of the count, with 99 % confidence.
SKETCH_K, RANK_ERROR = 800, 0.005


def daily_sketches(df: DataFrame, columns: Sequence[str], date_col: str = "pickup_date", k: int = SKETCH_K) -> DataFrame:
    """(date, column, n, sketch) of the non-null, non-NaN values, one row a day and column that has any."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    values = df.select(F.col(date_col).alias("date"), F.inline(F.array(*pairs))).where("v is not null and not isnan(v)")
    return values.groupBy("date", "column").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probabilities: Sequence[float], date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """(column, p, n, value) over the days of [date_from, date_to]."""
    days = sketches
    if date_from:
        days = days.where(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to:
        days = days.where(F.col("date") <= F.lit(date_to).cast("date"))
    merged = days.groupBy("column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probabilities]))
    found = merged.select("column", "n", F.posexplode(values).alias("_at", "value"))
    p = F.get(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("_at"))
    return found.select("column", p.alias("p"), "n", "value")


def sketch_medians(sketches: DataFrame, columns: Sequence[str], date_from: str | None = None, date_to: str | None = None) -> dict[str, float | None]:
    """Medians for ``prepare_features(medians=...)``; a column without values has none."""
    found = {r["column"]: r["value"] for r in merged_quantiles(sketches, [0.5], date_from, date_to).collect()}
    return {c: found.get(c) for c in columns}
