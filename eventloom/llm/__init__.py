"""Operators that prepare training text and vectors: filter, score, deduplicate, scan, pack."""
