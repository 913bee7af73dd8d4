"""Operators: functions from DataFrames to a DataFrame, lazy, with no action inside."""
