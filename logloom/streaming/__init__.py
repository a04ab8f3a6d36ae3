"""Incremental mining with Structured Streaming."""
