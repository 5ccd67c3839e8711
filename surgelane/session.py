"""Session settings and lineage cutting.

Operators never create sessions; jobs, tests and the bench do, through
``build_session``. Lineage is cut only with reliable ``checkpoint()`` into the
shared folder named by ``spark.checkpoint.dir`` (never a local checkpoint).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library assumes (timestamps are wall-clock NTZ,
# compared in UTC; AQE re-plans joins and partition counts at run time).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
}


def build_session(
    master: str | None = None,
    app_name: str = "surgelane",
    shuffle_partitions: int | None = None,
    checkpoint_dir: str | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Create (or get) a session with the library's settings.

    ``checkpoint_dir`` is applied only when the cluster did not already name
    one in ``spark.checkpoint.dir`` (tests and local runs pass a scratch dir).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if checkpoint_dir and not _conf_checkpoint_dir(spark):
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def _conf_checkpoint_dir(spark: SparkSession) -> str | None:
    value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not value:
        try:
            value = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover - conf not readable
            value = None
    return value or None


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (or a directory already set
    on the context); fails instead of silently using a machine-local folder.
    """
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    conf = _conf_checkpoint_dir(spark)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    raise RuntimeError(
        "spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) "
        "so lineage can be cut reliably"
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context.

    A job submitted with ``--py-files`` or an installed package needs no such
    call; a session that only has the repository on its own path does.
    """
    sc = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    if any(str(f).endswith(f"{name}.zip") for f in sc._python_includes):
        return
    # The driver serves the archive as long as the context lives.
    folder = tempfile.mkdtemp(prefix="ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    stage = os.path.join(folder, "stage")
    shutil.copytree(package, os.path.join(stage, name), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", stage))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root for a written table."""
    return f"{checkpoint_root(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage reliably (the files survive a lost executor) and lets several
    consumers read only the columns they need. The table goes when the driver's
    JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside the block."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder on the cluster's file system when the driver's JVM ends."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursively delete a folder on the cluster's file system (HDFS, S3, local)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(jpath, True))


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of a folder on the cluster's file system; none if there is no such folder."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()) if fs.exists(jpath) else []


class StateTables:
    """Versions of an iterative state written as Parquet tables in the shared
    checkpoint folder. Writing a new version truncates the lineage (the new
    DataFrame reads only its own files) and deletes the superseded version,
    so a long loop keeps one copy on storage instead of one per step.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name
        self.paths: list[str] = []

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        fresh = self.spark.read.schema(df.schema).parquet(path)
        for old in self.paths:
            delete_path(self.spark, old)
        self.paths = [path]
        return fresh

    def keep(self) -> None:
        """Leave the last version to its readers; it goes when the driver's JVM ends."""
        for path in self.paths:
            delete_on_exit(self.spark, path)
        self.paths = []

    def close(self) -> None:
        for old in self.paths:
            delete_path(self.spark, old)
        self.paths = []

    def __enter__(self) -> "StateTables":
        return self

    def __exit__(self, *exc) -> None:
        self.close()
