"""Mixing sources to target weights by hash-random keys and prefix sums.

Every row gets a hash-random key. Within its source, rows are ordered by that
key; a distributed prefix sum of sizes (totals of 4096 key ranges, then a sum
inside each range) tells which rows lie under the source's budget. A budget
above the source's size repeats whole epochs first and cuts the last one.

A hot source is spread over all its key ranges, so no task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Hex digits of the key that name a key range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words of the whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    totals: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """Targets of sources with weights dealt in code-point order (null last).

    ``totals`` has ``source`` and ``source_size``. The sources share ``share``
    times all sizes by weight; a target stops at ``cap`` times its source's size
    and the excess is shared again until none is above. That fixpoint is a water
    level: with sources ordered by cap over weight, a source is capped if the
    level left by those before it reaches its cap. One row per source, so the
    windows over all sources handle as many rows as there are source names.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = totals.withColumn("_rank", F.row_number().over(in_order) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    listed = listed.withColumn("_w", F.get(cycle, F.col("_rank") % len(weights))).withColumn(
        "_cap", F.col("source_size") * F.lit(float(cap))
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_rank"))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levelled = listed.withColumn("_level", level)
    # The first source whose cap is above the level fixes it for all that follow.
    open_level = F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), F.col("_level").alias("level")))
    final = F.min(open_level).over(everything)["level"]
    return levelled.select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(final * F.col("_w"), F.col("_cap"))).alias("target"),
    )


def mix(
    rows: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` to rows with ``doc_id``, ``source``, ``size``.

    All other columns pass through (names starting with ``_mix_`` are reserved).
    ``taken`` is whole epochs of the row plus its part of the cut epoch; the row
    at the cut is taken in part, so a source's sum is its target rounded down.
    Rows that tie in id and size are ordered by a hash of all their columns, which
    also is the key of rows without an id; null sources are one source; empty rows
    take 0; repeated rows count each. An empty table gives an empty table. Columns named
    like the three are replaced.
    """
    rows = rows.drop("source_size", "target", "taken")
    row_hash = F.xxhash64(*[f"`{c}`" for c, kind in rows.dtypes if "map<" not in kind])
    # Names compare by code point; "~" puts the null source behind all "=" names.
    keyed = rows.withColumns(
        {
            "_mix_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")),
            # Rows without an id are spread by their other columns.
            "_mix_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), row_hash.cast("string")))),
            "_mix_row": row_hash,
        }
    ).withColumn("_mix_range", F.substring("_mix_key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("_mix_source", "_mix_range").agg(F.sum("size").alias("_mix_total"))
    totals = ranges.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("_mix_total").alias("source_size"))
    targets = source_targets(totals, weights, share, cap).withColumnsRenamed(
        {"source": "_mix_source", "source_size": "_mix_size", "target": "_mix_target"}
    )
    before = Window.partitionBy("_mix_source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("_mix_before", F.coalesce(F.sum("_mix_total").over(before), F.lit(0)))
        .join(targets, "_mix_source")
        .drop("_mix_total")
    )
    placed = keyed.join(offsets, ["_mix_source", "_mix_range"])
    inside = Window.partitionBy("_mix_source", "_mix_range").orderBy("_mix_key", "doc_id", "size", "_mix_row").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("_mix_target").cast("long")
    epochs = F.when(F.col("_mix_size") > 0, F.floor(budget / F.col("_mix_size"))).otherwise(0).cast("long")
    start = F.col("_mix_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rest = budget - F.col("_mix_epochs") * F.col("_mix_size")
    return (
        placed.withColumn("_mix_epochs", epochs)
        .withColumn("_mix_start", start)
        .withColumn("taken", F.col("_mix_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_mix_start"))))
        .select(*rows.columns, F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("taken").cast("long").alias("taken"))
    )


def take_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it stands."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")
