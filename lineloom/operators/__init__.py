"""Operators over DataFrames of lines and sources."""
