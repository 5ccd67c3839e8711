"""Structured Streaming form of the ETL phase (same operators on readStream)."""

from surgelane.streaming.etl import start_etl_stream, stream_etl_transform  # noqa: F401
