"""Incremental graph building with Structured Streaming."""
