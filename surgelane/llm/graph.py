"""Connected components of an edge table, by alternating large and small stars.

Nothing is collected: edges live in tables of the shared folder, every step is
a grouped minimum (combined before its shuffle) joined back to the edges, where
adaptive execution splits the edges of a hub over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surgelane.session import StateTables


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (long ``a``, ``b``): label is the component's least node.

    Repeated edges, both directions and loops may occur; no edge, no row.
    """
    spark = edges.sparkSession
    star, least = StateTables(spark, "star"), StateTables(spark, "least")
    now = star.write(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = least.write(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        # Large star: every larger neighbour moves to the least of the neighbourhood.
        large = both.where("b > a").join(lows, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        now = star.write(large.where("a != b").distinct())
        lows = least.write(now.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        # Small star: smaller neighbours and the node itself hang on the least of them.
        small = now.join(lows, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lows.select(F.col("n").alias("a"), F.col("m").alias("b")))
        now = star.write(small.where("a != b").distinct())
        new = _state(now)
        if new == state:
            break
        state = new
    least.close()
    star.keep()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
