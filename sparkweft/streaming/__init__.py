"""Structured Streaming versions of the tallying operators."""
