"""File sources."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from surgelane.config import RAW_COLUMNS

log = logging.getLogger(__name__)

# Zone dimension, 4 columns, read without inference.
ZONE_SCHEMA = StructType(
    [
        StructField("LocationID", IntegerType(), True),
        StructField("Borough", StringType(), True),
        StructField("Zone", StringType(), True),
        StructField("service_zone", StringType(), True),
    ]
)


def tolerant_select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the requested columns that exist, in the requested order.

    Missing columns are skipped with a warning, not an error.
    """
    present = set(df.columns)
    keep = [c for c in columns if c in present]
    missing = [c for c in columns if c not in present]
    if missing:
        log.warning("columns not found, skipped: %s", missing)
    return df.select(*keep)


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both, for the drift that monthly files show.

    Whole numbers widen to the longer one; whole numbers and fractions to double
    (beyond 2 ** 53 the nearest); decimals keep all digits while 38 do; dates
    widen to timestamps, and a timestamp with and one without zone to wall-clock
    time; text takes anything simple.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    kinds = {type(a), type(b)}
    if kinds <= set(_INTEGRAL):
        return max(a, b, key=lambda t: _INTEGRAL.index(type(t)))
    if T.DecimalType in kinds and kinds <= {T.DecimalType, *_INTEGRAL}:
        digits = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else ((3, 5, 10, 20)[_INTEGRAL.index(type(t))], 0) for t in (a, b)]
        whole, scale = max(d[0] for d in digits), max(d[1] for d in digits)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if kinds <= {T.FloatType, T.DoubleType, T.DecimalType, *_INTEGRAL}:
        return T.DoubleType()
    if kinds <= {T.DateType, T.TimestampType, T.TimestampNTZType}:
        return T.TimestampType() if kinds == {T.DateType, T.TimestampType} else T.TimestampNTZType()
    if T.StringType in kinds and not kinds & {T.StructType, T.ArrayType, T.MapType, T.BinaryType}:
        return T.StringType()
    raise ValueError(f"no common type of {a.simpleString()} and {b.simpleString()}")


def reconcile(schemas: Sequence[StructType]) -> StructType:
    """Columns of all schemas in order of appearance, by name whatever its case, each of its widest type."""
    fields: dict[str, StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            old = fields.get(f.name.lower())
            try:
                kind = widest(old.dataType, f.dataType) if old else f.dataType
            except ValueError as e:
                raise ValueError(f"column {f.name}: {e}") from None
            fields[f.name.lower()] = StructField(old.name if old else f.name, kind, True)
    return StructType(list(fields.values()))


def schema_groups(spark: SparkSession, files: Sequence[str]) -> list[tuple[StructType, list[str]]]:
    """Files grouped by what Spark can read as one: (merged schema, files).

    Spark merges the footers in a distributed job; files whose column types clash
    are halved until they merge, so a change of types at some month costs a job
    for each halving, not one for each file.
    """
    try:
        schema = spark.read.option("mergeSchema", "true").parquet(*files).schema
        return [(schema, list(files))]
    except (Py4JJavaError, PySparkException) as e:
        if len(files) == 1 or "CANNOT_MERGE_SCHEMAS" not in str(e):
            raise
    middle = len(files) // 2
    return schema_groups(spark, files[:middle]) + schema_groups(spark, files[middle:])


def read_drifting(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """All rows of files whose columns come and go or change type: one scan per group of like files, and a union.

    Columns have their widest type; a file without a column gives nulls. Each
    scan prunes and filters for itself.
    """
    by_types: dict[str, tuple[StructType, list[str]]] = {}
    for schema, group in schema_groups(spark, sorted(files)):
        by_types.setdefault(schema.simpleString(), (schema, []))[1].extend(group)
    groups = list(by_types.values())
    target = reconcile([schema for schema, _ in groups])
    out = None
    for schema, group in groups:
        have = {f.name.lower(): f for f in schema.fields}
        columns = []
        for f in target.fields:
            own = have.get(f.name.lower())
            c = F.lit(None).cast(f.dataType) if own is None else F.col(f"`{own.name}`")
            columns.append((c if own is None or own.dataType == f.dataType else c.cast(f.dataType)).alias(f.name))
        part = spark.read.schema(schema).parquet(*group).select(*columns)
        out = part if out is None else out.unionAll(part)
    return out


def read_parquet(
    spark: SparkSession, paths: str | Iterable[str], columns: Sequence[str] | None = RAW_COLUMNS
) -> DataFrame:
    """Parquet scan (path, directory or glob) with tolerant column pruning.

    Several files may differ in their columns and types (see ``read_drifting``).
    Only the selected columns reach the scan's ReadSchema. A missing path fails
    with Spark's own PATH_NOT_FOUND error.
    """
    if isinstance(paths, str):
        paths = [paths]
    df = spark.read.parquet(*paths)
    files = [unquote(f) for f in df.inputFiles()]
    # Directories with partition columns keep Spark's own reading.
    if len(files) > 1 and not any("=" in f.rsplit("/", 2)[-2] for f in files):
        df = read_drifting(spark, files)
    return tolerant_select(df, columns) if columns is not None else df


def read_zone_csv(spark: SparkSession, path: str) -> DataFrame:
    """Zone lookup CSV with a header and the fixed schema (no inference)."""
    return spark.read.schema(ZONE_SCHEMA).option("header", "true").csv(path)


def read_partitioned(
    spark: SparkSession,
    path: str,
    date_from: str | None = None,
    date_to: str | None = None,
    hours: Sequence[int] | None = None,
    date_col: str = "pickup_date",
    hour_col: str = "hour",
) -> DataFrame:
    """Read a (pickup_date, hour) Hive-partitioned table with partition pruning.

    Predicates on the partition columns become PartitionFilters, so only the
    matching directories are listed and read. ``date_from``/``date_to`` are
    inclusive ISO dates.
    """
    df = spark.read.parquet(path)
    cond = F.lit(True)
    if date_from is not None:
        cond = cond & (F.col(date_col) >= F.lit(date_from).cast("date"))
    if date_to is not None:
        cond = cond & (F.col(date_col) <= F.lit(date_to).cast("date"))
    if hours is not None:
        cond = cond & F.col(hour_col).isin(list(hours))
    return df.filter(cond) if (date_from or date_to or hours is not None) else df


def require_not_empty(df: DataFrame, name: str) -> DataFrame:
    """Fail fast on an empty input (one-row probe, no full count)."""
    if df.isEmpty():
        raise ValueError(f"{name} is empty")
    return df


# Columns of the weather table.
WEATHER_COLUMNS = (
    "date",
    "hour",
    "temperature_f",
    "precipitation_in",
    "wind_speed_mph",
    "visibility_miles",
    "weather_condition",
)


def normalize_date(c, dtype) -> "F.Column":
    """DATE from a date, a timestamp, or epoch nanoseconds (pandas-written files)."""
    name = dtype.typeName()
    if name == "date":
        return c
    if name in ("long", "integer"):
        return F.to_date(F.timestamp_micros(F.floor(c / 1000)))
    return F.to_date(c)


def read_weather(spark: SparkSession, path: str, nanos_date: bool = False) -> DataFrame:
    """Hourly weather with ``date`` as DATE and ``hour`` as INT.

    Files written from pandas store ``date`` as Parquet TIMESTAMP(NANOS), which
    Spark refuses; with ``nanos_date`` the caller says so, and the column is read
    as a number by an explicit schema (no probe, no session-wide setting).
    """
    if nanos_date:
        fields = ["date long", "hour int", *(f"{c} double" for c in WEATHER_COLUMNS[2:-1]), "weather_condition string"]
        df = spark.read.schema(", ".join(fields)).parquet(path)
    else:
        df = spark.read.parquet(path)
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = df.withColumns(
        {"date": normalize_date(F.col("date"), fields["date"]), "hour": F.col("hour").cast("int")}
    )
    return tolerant_select(out, WEATHER_COLUMNS)
