"""Operators for training data: counting, deduplication, scoring and selection of texts."""
