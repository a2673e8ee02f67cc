"""Batch operators: each takes DataFrames in canonical columns and returns a DataFrame."""
