"""Composed jobs: the questions a user asks, built from operators."""
