"""Streaming forms of operators whose result can grow with the readings."""

from tidemill.streaming.live import downsample_stream, latest_reading_stream

__all__ = ["downsample_stream", "latest_reading_stream"]
