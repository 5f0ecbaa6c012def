"""Operators for preparing text corpora at scale.

Nothing outside this folder imports it.  Every operator takes DataFrames with the
columns it names, ignores further columns and states in its docstring what nulls,
empty texts, ties and repeated rows give.
"""
