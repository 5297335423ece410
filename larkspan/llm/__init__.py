"""Operators of a training-data pipeline over a table of documents.

Every module here stands alone on PySpark (and numpy where its docstring says so); nothing else in
the library imports this subpackage.
"""
