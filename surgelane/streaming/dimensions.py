"""Zone lookup (J1, J2) on a stream while the zone table changes.

Versions of the zone table are rows with the half-open time they hold for,
[valid_from, valid_to). Every micro-batch reads the versions written so far and
joins each trip to the zone that held at its pickup time, whenever it arrives,
so a replay gives the same names as the live run did after the same changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from surgelane.config import DO_LOC, PARTITION_KEYS, PICKUP_TS, PU_LOC
from surgelane.operators.dimensions import unique_side

VERSION_SCHEMA = "LocationID int, Borough string, Zone string, service_zone string, valid_from timestamp_ntz"


def add_zone_version(zones: DataFrame, valid_from: str, path: str) -> str:
    """Append a zone table (whole or only the changed zones) that holds from ``valid_from`` (ISO time) on."""
    rows = zones.select("LocationID", "Borough", "Zone", "service_zone", F.lit(valid_from).cast("timestamp_ntz").alias("valid_from"))
    rows.coalesce(1).write.mode("append").parquet(path)
    return path


def zone_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions with ``valid_to``: the time the zone's next version starts, null for the last.

    A zone given twice from one time on fails the query that reads it.
    """
    rows = spark.read.schema(VERSION_SCHEMA).parquet(path)
    rows = unique_side(rows, ["LocationID", "valid_from"])
    following = F.lead("valid_from").over(Window.partitionBy("LocationID").orderBy("valid_from"))
    return rows.withColumn("valid_to", following)


def join_zones_as_of(trips: DataFrame, versions: DataFrame, at: str = PICKUP_TS) -> DataFrame:
    """Add pickup_/dropoff_ borough, zone and service_zone that held at ``at``; null before a zone's first version.

    At most one version of a zone holds at a time, so no trip is multiplied. The
    zone's versions are gathered into one row (they are few), the trips meet
    that row by an equi-join and look their version up in it.
    """
    out = trips
    by_zone = versions.groupBy("LocationID").agg(
        F.collect_list(F.struct("valid_from", "valid_to", "Borough", "Zone", "service_zone")).alias("_versions")
    )
    for prefix, loc in (("pickup", PU_LOC), ("dropoff", DO_LOC)):
        side = by_zone.select(F.col("LocationID").alias(f"_{prefix}_id"), "_versions")
        holds = lambda v: (v["valid_from"] <= F.col(at)) & (v["valid_to"].isNull() | (F.col(at) < v["valid_to"]))
        found = F.get(F.filter("_versions", holds), F.lit(0))
        out = out.join(side, F.col(loc) == F.col(f"_{prefix}_id"), "left").withColumns(
            {f"{prefix}_borough": found["Borough"], f"{prefix}_zone": found["Zone"], f"{prefix}_service_zone": found["service_zone"]}
        ).drop(f"_{prefix}_id", "_versions")
    return out


def start_versioned_stream(trips: DataFrame, versions_path: str, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append trips with the zones that held at their pickup to the (pickup_date, hour) table.

    Each micro-batch writes a folder of its own number, so a repeated batch replaces its rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        joined = join_zones_as_of(batch, zone_versions(batch.sparkSession, versions_path))
        joined.hint("rebalance", *PARTITION_KEYS).write.mode("overwrite").partitionBy(*PARTITION_KEYS).parquet(f"{out_path}/batch={number}")

    writer = trips.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
