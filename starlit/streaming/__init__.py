"""Incremental (Structured Streaming) form of the light-curve file ingest."""

from starlit.streaming.ingest import stream_light_curves  # noqa: F401
