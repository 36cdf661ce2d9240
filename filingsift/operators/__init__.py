"""Operators of the core: lazy DataFrames in, lazy DataFrames out."""
