"""Lines that keep arriving: parsed as they come, and grouped into incidents behind a watermark."""

from emberlog.streaming.incidents import stream_grouped
from emberlog.streaming.parse import stream_parsed

__all__ = ["stream_grouped", "stream_parsed"]
