"""Operators: each takes DataFrames and returns DataFrames, and starts no job of its own."""
