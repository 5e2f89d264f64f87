"""Operators of a training-data pipeline over the document and vector tables.

Nothing else in the library imports this subpackage.
"""
