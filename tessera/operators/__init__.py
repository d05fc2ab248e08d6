"""Operators that DataFrames do not have as such."""
