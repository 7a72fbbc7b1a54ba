"""Queries that also run on streams: the functions take a batch or a streaming DataFrame."""

from .events import windowed_counts

__all__ = ["windowed_counts"]
