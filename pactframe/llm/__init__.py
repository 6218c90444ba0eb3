"""Operators for preparing language-model training data: ten of them, each with its own method.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames
and keeps only what its tasks need in memory; see the module docstrings for the defined results on
nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns.
"""
