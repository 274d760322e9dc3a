"""Relational operators: each takes DataFrames and returns a lazily composed DataFrame."""
