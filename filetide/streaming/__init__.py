"""Structured Streaming counterparts of the history and search operators."""
