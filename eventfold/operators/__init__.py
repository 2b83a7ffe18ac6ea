"""Relational operators over record DataFrames."""
