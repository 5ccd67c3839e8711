"""Small expression helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_type(df: DataFrame, name: str):
    return df.schema[name].dataType


def ts_literal(df: DataFrame, column: str, text: str) -> Column:
    """A timestamp literal of the column's own type (NTZ or LTZ).

    Casting the literal, not the column, keeps the predicate pushable to the
    Parquet scan.
    """
    return F.lit(text).cast(col_type(df, column))


def epoch_seconds(column: str | Column) -> Column:
    """Whole seconds since the epoch (sub-seconds floored)."""
    return F.unix_timestamp(column)


def safe_div(num: Column, den: Column, guard: Column | None = None, default=0.0) -> Column:
    """``num / den`` when the guard holds (default ``den > 0``), else default.

    The division sits in the lazy branch so ANSI mode never sees ``/0``.
    """
    cond = guard if guard is not None else den > 0
    return F.when(cond, num / den).otherwise(F.lit(default))


def round_half_up(c: Column, digits: int) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d`` in double arithmetic.

    Same bits in any IEEE engine, so report columns compare exactly.
    """
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def flag(cond: Column) -> Column:
    """0/1 integer flag; NULL conditions give 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (report/compare form; order of columns kept)."""
    return df.select(
        *[
            round_half_up(F.col(f.name), digits).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
