"""Operators for preparing training data: deduplication, filtering, search, mixing, formatting, tokens."""
