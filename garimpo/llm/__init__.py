"""Operators on texts, vectors and distributions for training-data pipelines."""
