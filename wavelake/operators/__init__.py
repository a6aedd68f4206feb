"""Operators: functions from DataFrames to DataFrames, grouped by what they work on."""
