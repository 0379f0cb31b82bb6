"""Operators: DataFrames in, DataFrame out, nothing collected."""
