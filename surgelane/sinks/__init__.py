"""Writers: partitioned processed table, feature table, model artifacts."""

from surgelane.sinks.tables import (  # noqa: F401
    output_size,
    write_feature_table,
    write_partitioned,
    write_weather_table,
)
