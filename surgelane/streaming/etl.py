"""Phase A on a stream: raw trip files arriving in a folder are filtered,
given calendar features and zone names, and appended to the
(pickup_date, hour)-partitioned table.

Every step is stateless per row (filters, projections, a static-dimension
join), so no watermark or state store is needed and exactly-once output comes
from the file sink's commit log under the checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from surgelane.config import PARTITION_KEYS, PU_LOC
from surgelane.plans.etl import etl_transform


def stream_etl_transform(stream: DataFrame, zones: DataFrame | None) -> DataFrame:
    """Quality filter, calendar features and zone lookup on a streaming frame.

    The zone dimension is static here; each micro-batch checks its keys in the
    plan. ``streaming.dimensions`` joins one that changes.
    """
    return etl_transform(stream, zones)


def start_etl_stream(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    out_path: str,
    checkpoint: str,
    zones: DataFrame | None = None,
    adapter: Callable[[DataFrame], DataFrame] | None = None,
    glob: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the streaming ETL; ``adapter`` maps source rows to trip columns.

    ``checkpoint`` belongs to this stream alone. ``available_now`` processes everything present and stops (batch-like
    backfill with streaming bookkeeping); otherwise it runs continuously.
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(source_dir)
    trips = adapter(raw) if adapter else raw
    out = stream_etl_transform(trips, zones)
    # A shuffle by partition and a quarter of the locations: at most four files per
    # directory and trigger, and a hot hour has four writers.
    writer = (
        out.repartition(*PARTITION_KEYS, F.pmod(F.xxhash64(PU_LOC), F.lit(4)))
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*PARTITION_KEYS)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
