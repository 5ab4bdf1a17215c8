"""Operators of a training-data pipeline: each takes and returns DataFrames.

Nothing else in the library imports this subpackage.
"""
