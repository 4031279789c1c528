"""Parallel-text curation and translation analytics on Spark."""
