"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; the ``queries`` module holds the thin registered queries.
"""
