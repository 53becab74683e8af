"""Operators for training-data pipelines: text, vectors and web pages at corpus scale."""
