"""Indexes kept current from a stream of rows."""

from vecspark.streaming.maintenance import insert_stream

__all__ = ["insert_stream"]
