"""Readers of listings and designs, writers of snapshots and reports."""
