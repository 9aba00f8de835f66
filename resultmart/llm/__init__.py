"""Operators of a large-scale training-data pipeline, each a Spark job over a table of documents, vectors or pages.

Nothing else in the package imports this subpackage.
"""
