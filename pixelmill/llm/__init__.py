"""Operators for training-data pipelines on document tables."""
