"""Operators for large training corpora.

Nothing outside this package imports it; ``queries`` holds the registered
queries and their SQL.
"""
