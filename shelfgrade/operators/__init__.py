"""Operators over DataFrames; tables and column names are parameters."""
