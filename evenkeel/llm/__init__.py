"""Operators for preparing training data: language, quality, duplicates, contamination, mixing and token output."""
