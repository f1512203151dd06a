"""Operators for large-scale training-data pipelines over document tables."""
