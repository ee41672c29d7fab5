"""Operators for large-scale training-data pipelines, written Spark-first.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` registers one query per
operator over the given tables.
"""
