"""Operators for training-data corpora; nothing outside this package imports it."""
