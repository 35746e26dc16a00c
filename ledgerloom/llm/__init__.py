"""Training-data operators: thirteen corpus-scale stages over documents, pages and vectors.

Nothing outside this package imports it. Every operator takes DataFrames and
returns DataFrames; `queries` and `oracle` hold the thin entry points.
"""
