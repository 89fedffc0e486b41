"""Structured Streaming versions of the text operators."""
