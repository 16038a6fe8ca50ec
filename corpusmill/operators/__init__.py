"""Operators: functions from DataFrames to DataFrames, lazy, without collecting."""
