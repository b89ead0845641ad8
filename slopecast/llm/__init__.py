"""Operators for training-data preparation over tables of texts, turns and benchmark items."""
