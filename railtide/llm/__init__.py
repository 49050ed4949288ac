"""Operators for training data: percentile summaries, packing, leakage search and reading level."""
