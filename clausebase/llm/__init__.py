"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  ``entries`` holds the registered
queries and their SQL; each operator has a module of its own.
"""
