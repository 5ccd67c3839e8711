"""Feature matrix preparation (M1) and the reproducible train/validation split (M2)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surgelane.config import BOOST, MODEL_FEATURES, TARGET
from surgelane.session import materialise
from surgelane.sources.files import tolerant_select

_INF = float("inf")


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (c != _INF) & (c != -_INF)


def _nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def available_features(df: DataFrame, features: Sequence[str] = MODEL_FEATURES, exclude=()) -> list[str]:
    return tolerant_select(df, [c for c in features if c not in set(exclude)]).columns


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column (interpolated), NULL and NaN ignored, +-inf kept as values.

    Values are counted, the counts range-partitioned by (column, value) and
    written; sums per partition tell which partition holds a column's middle
    ranks, and only those are summed up value by value. No task holds a column;
    two values a column reach the driver.
    """
    if not columns:
        return {}
    spark = df.sparkSession
    pairs = [F.struct(F.lit(c).alias("c"), _nan_to_null(F.col(c).cast("double")).alias("v")) for c in columns]
    values = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").where("v is not null")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = values.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.repartitionByRange(n, "c", "v").withColumn("part", F.spark_partition_id()), "value_counts")
    ahead = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("c", "part").agg(F.sum("n").alias("size"))
    parts = parts.withColumns(
        {"before": F.coalesce(F.sum("size").over(ahead), F.lit(0)), "total": F.sum("size").over(Window.partitionBy("c"))}
    ).withColumns({"low": F.floor((F.col("total") - 1) / 2), "high": F.floor(F.col("total") / 2)})
    middle = parts.where((F.col("before") <= F.col("high")) & (F.col("low") < F.col("before") + F.col("size")))
    upto = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(middle, ["c", "part"]).withColumn("end", F.col("before") + F.sum("n").over(upto))
    start = F.col("end") - F.col("n")
    holds = lambda rank: (start <= F.col(rank)) & (F.col(rank) < F.col("end"))
    found = ranked.groupBy("c").agg(F.max(F.when(holds("low"), F.col("v"))).alias("low"), F.max(F.when(holds("high"), F.col("v"))).alias("high"))
    medians = {r["c"]: r["low"] if r["low"] == r["high"] else (r["low"] + r["high"]) / 2.0 for r in found.collect()}
    return {c: medians.get(c) for c in columns}


def prepare_features(
    df: DataFrame,
    features: Sequence[str] = MODEL_FEATURES,
    target: str = TARGET,
    exclude: Sequence[str] = (),
    keep: Sequence[str] = (),
    medians: Callable[[Sequence[str]], dict[str, float | None]] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Model-ready columns: available features as double, NULL/NaN filled with
    the column median, remaining NaN/+-inf set to 0; target NULL/NaN/+-inf set
    to the target median. Returns (DataFrame[keep..., features..., target], names).

    The needed columns are written once; a NULL/NaN/inf count, the medians of
    the columns that need one, and the result all read that table. ``medians``
    gives those of some columns from elsewhere (sketches) instead of exactly.
    """
    if target not in df.columns:
        raise ValueError(f"no target {target!r} among {sorted(df.columns)}")
    names = available_features(df, features, exclude)
    df = materialise(df.select(*keep, *names, target), "feature_columns")
    counts = df.agg(
        *[F.sum(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0)).alias(c)
          for c in names],
        F.sum(F.when(F.col(target).isNull() | ~_finite(F.col(target).cast("double")), 1).otherwise(0)).alias(
            "__target__"
        ),
    ).first()
    need = [c for c in names if (counts[c] or 0) > 0]
    target_bad = (counts["__target__"] or 0) > 0
    wanted = need + ([target] if target_bad else [])
    medians = medians(wanted) if medians else column_medians(df, wanted)

    cols = []
    for c in names:
        v = _nan_to_null(F.col(c).cast("double"))
        if c in need and medians.get(c) is not None:
            v = F.coalesce(v, F.lit(float(medians[c])))
        cols.append(F.when(v.isNotNull() & _finite(v), v).otherwise(F.lit(0.0)).alias(c))
    y = F.col(target).cast("double")
    if target_bad:
        med = medians.get(target)
        fill = F.lit(float(med)) if med is not None else F.lit(None).cast("double")
        y = F.when(y.isNull() | ~_finite(y), fill).otherwise(y)
    return df.select(*[F.col(k) for k in keep], *cols, y.alias(target)), names


# Buckets of the split: fractions are exact to a millionth.
SPLIT_BUCKETS = 1_000_000


def split_bucket(key: Column, seed: int = BOOST.seed) -> Column:
    """Stable bucket 0..999999 from the md5 of 'seed:key' (same in any engine).

    The hash modulo 100 leads, so a whole-percent fraction takes whole buckets of a hundredth.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    word = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return word % 100 * (SPLIT_BUCKETS // 100) + F.floor(word / 100) % (SPLIT_BUCKETS // 100)


def train_val_split(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    fraction: float = BOOST.validation_fraction,
    seed: int = BOOST.seed,
    output: str = "is_validation",
) -> DataFrame:
    """Flag ~``fraction`` of rows as validation by hashing a row key.

    Unlike ``randomSplit`` the assignment does not depend on partitioning, so a
    recomputed partition (lost executor, AQE re-plan) lands on the same side.
    Without a key, a hash of all columns is used.
    """
    if key is None:
        k = F.xxhash64(*[F.col(c) for c in df.columns])
    elif isinstance(key, str):
        k = F.col(key)
    else:
        k = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    return df.withColumn(output, split_bucket(k, seed) < round(fraction * SPLIT_BUCKETS))
