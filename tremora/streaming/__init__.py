"""Structured Streaming forms of the incremental load and of daily activity."""
