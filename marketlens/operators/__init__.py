"""Operators: functions from DataFrames to a DataFrame, without state of their own."""
