"""Structured Streaming jobs over the click stream."""
