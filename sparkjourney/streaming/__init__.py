"""Structured Streaming forms of the session operators."""

from sparkjourney.streaming.sessions import stream_session_stats, stream_event_counts  # noqa: F401
