"""Readers: tolerant Parquet scans, the zone CSV, partitioned re-reads."""

from surgelane.sources.files import (  # noqa: F401
    ZONE_SCHEMA,
    read_parquet,
    read_partitioned,
    read_zone_csv,
    require_not_empty,
    tolerant_select,
)
