"""Continuous import of export files as they arrive (Structured Streaming)."""

from memlake.streaming.ingest import start_import_stream  # noqa: F401
