"""Operators of a training-data pipeline over tables of documents and vectors.

Nothing else in the library imports this subpackage. Every operator picks the
columns it needs by name first, so further columns of its input never clash.
"""
