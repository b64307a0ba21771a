"""Operators for training-data corpora: search, deduplication, tokens, packing, filters."""
