"""Operators: functions from DataFrames to DataFrames, keyed by id, never by position."""
