"""Contiguous shards of near equal bytes from global prefix sums.

Rows are ordered by a hash of their text, so equal texts stand together. Byte
totals of 4096 hash ranges give every range its global offset, a sum inside the
range gives every row its own, and equal targets cut the order into shards. A
cut never falls inside a group of equal texts unless the group alone is larger
than a shard.

Groups above a small part of a shard's target (at most ``n_shards / tolerance``
of them, whatever the input) would make the cuts uneven; they are placed first,
the largest onto the emptiest shard, and the others fill what is left. Such a
group's rows are ordered and dealt by a hash of their id, so a hot text is
spread over all ranges as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surgelane.session import materialise

# A group above this part of a shard's target is placed on its own.
TOLERANCE = 0.01
RANGE_BITS = 12
# The run of all groups that are not placed on their own.
SMALL = -1


def place(groups: list[tuple[int, int]], total: int, n_shards: int) -> list[tuple[int, int, int, int]]:
    """Segments (run, from byte, to byte, shard) for large groups and the rest.

    ``groups``: (hash, bytes) of the large ones. A group up to a shard's target
    goes whole to the emptiest shard; a larger one is cut into the free room.
    """
    target = total / n_shards
    load = [0] * n_shards
    segments = []
    for run, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0
        while at < size:
            shard = min(range(n_shards), key=lambda s: (load[s], s))
            room = size - at if size <= target else max(1, min(size - at, round(target - load[shard])))
            segments.append((run, at, at + room, shard))
            load[shard] += room
            at += room
    rest = total - sum(load)
    free = [max(0.0, target - x) for x in load]
    scale = rest / sum(free) if sum(free) > 0 else 0.0
    at, cut = 0.0, 0
    for shard in range(n_shards):
        at += free[shard] * scale
        end = rest + 1 if shard == n_shards - 1 else round(at)
        if end > cut:
            segments.append((SMALL, cut, end, shard))
        cut = max(cut, end)
    return segments


def shard_by_bytes(rows: DataFrame, n_shards: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows with ``doc_id``, ``size``, ``group_hash`` (0 or more).

    Slots count from 0 without gaps in each shard. Other columns pass through.
    Null ids take part like any id; repeated rows each get a slot of their own;
    an empty table gives an empty table. Columns named like the two are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    n_rows, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = total or 0
    large = []
    if n_rows:
        # Each has more than tolerance * total / n_shards bytes: at most n_shards / tolerance rows.
        large = [
            (r[0], r[1])
            for r in rows.groupBy("group_hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > total / n_shards * tolerance).collect()
        ]
    segments = spark.createDataFrame(place(large, total, n_shards), "_run long, _from long, _to long, shard int")
    runs = spark.createDataFrame([(h,) for h, _ in large], "_big long")
    shift = 63 - RANGE_BITS
    marked = rows.withColumn("_row_hash", F.shiftrightunsigned(F.xxhash64("doc_id", "size"), 1)).join(
        F.broadcast(runs), F.col("group_hash") == F.col("_big"), "left"
    )
    marked = marked.withColumns(
        {
            "_run": F.coalesce(F.col("_big"), F.lit(SMALL)),
            "_range": F.shiftright(F.when(F.col("_big").isNull(), F.col("group_hash")).otherwise(F.col("_row_hash")), shift).cast("int"),
        }
    )
    before = Window.partitionBy("_run").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("_run", "_range").agg(F.sum("size").alias("_bytes"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_bytes").over(before), F.lit(0))).drop("_bytes")
    # A small group lies where it starts; a row of a large group where it stands itself.
    cell = Window.partitionBy("_run", "_range")
    group_start = F.sum("size").over(cell.orderBy("group_hash").rangeBetween(Window.unboundedPreceding, -1))
    row_start = F.sum("size").over(cell.orderBy("group_hash", "_row_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = (
        marked.withColumn("_group_at", group_start)
        .withColumn("_row_at", row_start)
        .join(offsets, ["_run", "_range"])
        .withColumn("_at", F.col("_offset") + F.coalesce(F.when(F.col("_big").isNull(), F.col("_group_at")).otherwise(F.col("_row_at")), F.lit(0)))
        .join(F.broadcast(segments.withColumnRenamed("_run", "_seg")), (F.col("_run") == F.col("_seg")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
        .select(*rows.columns, "shard", "_run", "_range", "_row_hash")
    )
    placed = materialise(placed, "shards")
    counts = placed.groupBy("shard", "_run", "_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_run", "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_run", "_range").orderBy("group_hash", "_row_hash", "doc_id")
    return placed.join(starts, ["shard", "_run", "_range"]).select(
        *rows.columns, "shard", (F.col("_start") + F.row_number().over(inside) - 1).cast("long").alias("slot")
    )


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, group_hash): UTF-8 bytes plus 1 (null: 1), and the group of equal texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("group_hash"),
    )
