"""Structured Streaming queries and stateful processors."""
