"""Operators over DataFrames; each takes column names, so none is bound to one table."""
