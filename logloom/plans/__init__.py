"""Composed jobs (mining pipeline) and the query registry."""
