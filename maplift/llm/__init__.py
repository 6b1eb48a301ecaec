"""Operators of a training-data pipeline over `documents` and its sister tables.

Nothing else in the library imports this subpackage.
"""
