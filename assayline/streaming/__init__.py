"""Structured Streaming jobs."""

from assayline.streaming.score_stream import read_stream, score_stream

__all__ = ["read_stream", "score_stream"]
