"""Incremental (Structured Streaming) variants of batch operators."""
