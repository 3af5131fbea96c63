"""Operators for preparing training data: search, deduplication, mixing, packing, scanning and scoring of texts."""
