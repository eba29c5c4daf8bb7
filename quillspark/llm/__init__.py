"""Training-data operators: ten document transforms for corpora of any size.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries`` holds the thin, fixed-contract queries.
"""
