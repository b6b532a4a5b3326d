"""Operators for large-scale training-data pipelines.

Every module keeps a general interface over DataFrames; ``queries`` holds the
thin registered queries and their SQL. Nothing else in the library imports
this subpackage.
"""
