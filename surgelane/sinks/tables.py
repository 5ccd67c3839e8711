"""Table sinks (K1-K3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surgelane.config import FEATURE_TABLE_COLUMNS, PARTITION_KEYS
from surgelane.sources.files import tolerant_select


def write_partitioned(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = PARTITION_KEYS,
    max_records_per_file: int = 5_000_000,
    mode: str = "overwrite",
) -> str:
    """Hive-partitioned snappy Parquet by (pickup_date, hour).

    A REBALANCE on the partition keys lets AQE size the writers from the
    measured shuffle: small hours are coalesced into one task (one file per
    directory instead of one per upstream task), and a hot hour is split into
    several advisory-size tasks instead of landing on a single writer.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode(mode)
        .partitionBy(*keys)
        .option("compression", "snappy")
        .option("maxRecordsPerFile", max_records_per_file)
        .parquet(path)
    )
    return path


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], path: str, buckets: int | None = None) -> DataFrame:
    """A table in ``buckets`` files by a hash of ``keys`` (default: a shuffle partition each), sorted by them; read back.

    Joins and groupings on the keys read the buckets as they are: the table's
    rows are not shuffled again. Rows are dealt to the buckets before the write,
    so a bucket is one file. ``path`` holds the data, ``table`` names it in the
    session's catalog.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, *keys).write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path, from the file system's own count."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(jpath).getLength())


def output_size(df: DataFrame) -> DataFrame:
    """Files and bytes behind a file-based DataFrame, from the scan's metadata."""
    return (
        df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        .distinct()
        .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    )


def output_directories(df: DataFrame) -> DataFrame:
    """Rows of each directory that a partitioned table has files in."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"(pickup_date=[^/]+/hour=[^/]+)/", 1)
    return df.groupBy(folder.alias("directory")).agg(F.count(F.lit(1)).alias("n_rows"))


def write_feature_table(df: DataFrame, path: str, mode: str = "overwrite", only_touched: bool = False) -> str:
    """The 36 feature columns (those present) by pickup date, snappy Parquet.

    With ``only_touched`` the dates in ``df`` are replaced and all others stay.
    """
    out = tolerant_select(df, FEATURE_TABLE_COLUMNS).hint("rebalance", "pickup_date")
    writer = out.write.mode(mode).partitionBy("pickup_date").option("compression", "snappy")
    if only_touched:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """The written feature table, columns in declared order."""
    return tolerant_select(spark.read.parquet(path), FEATURE_TABLE_COLUMNS)


def write_weather_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Hourly weather with ``date`` as DATE and ``hour`` as INT (never a
    nanosecond timestamp), one small file."""
    out = df.withColumns({"date": F.to_date("date"), "hour": F.col("hour").cast("int")})
    out.coalesce(1).write.mode(mode).option("compression", "snappy").parquet(path)
    return path
