"""Operators on DataFrames of reads."""
