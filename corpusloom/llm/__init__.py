"""Operators for training-data pipelines; nothing outside imports this."""
