"""Operators: functions from DataFrames to DataFrames, grouped by ``dataset_id``."""
