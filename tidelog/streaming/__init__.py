"""Structured Streaming: ingest into a store, and a running state of newest writes."""

from .ingest import ingest, newest_per_key

__all__ = ["ingest", "newest_per_key"]
