"""Compositions of several operators into whole checks."""
