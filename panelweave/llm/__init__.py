"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries`` binds them to the tables of a data folder.
"""
