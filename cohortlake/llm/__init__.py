"""Operators for large text corpora: one module per operator, each a function from DataFrames to a DataFrame.

Nothing outside this package imports it.
"""
