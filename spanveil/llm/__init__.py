"""Operators for preparing language-model training data, one module each.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames, reads only the columns its docstring names, and returns a
DataFrame; ``queries`` holds the thin registered queries.
"""
