"""Operators for preparing text corpora for model training.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, reads only the columns it is told to read (so extra columns, also
ones with clashing names, never matter) and states its null and empty cases
in its docstring.
"""
