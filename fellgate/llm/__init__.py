"""Operators of a training-data pipeline: search, tokens, scoring, packing, deduplication, extraction."""
