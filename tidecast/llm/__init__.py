"""Operators for large text corpora: one module per operator, ``catalog`` registers their queries.

Every operator takes a DataFrame of documents and names of its key and text column,
reads nothing else of it, and returns a DataFrame of its own columns, so columns with
clashing names never meet.
"""
