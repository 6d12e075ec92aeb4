"""Corpus operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; ``registry`` holds the registered queries.
"""
