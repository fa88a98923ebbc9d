"""Ingest from streams into a store."""

from tidemark.streaming.ingest import ingest, latest_per_key

__all__ = ["ingest", "latest_per_key"]
