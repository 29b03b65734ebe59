"""Operators for training-data pipelines: mixing, archives, deduplication, tokens, models."""
