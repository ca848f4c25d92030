"""Operators: functions from DataFrames to DataFrames, no actions inside."""
