"""Operators from DataFrames to DataFrames."""
