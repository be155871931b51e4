"""Structured Streaming forms of the incremental loops."""
