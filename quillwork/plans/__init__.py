"""Compositions of the operators: what a user calls."""
