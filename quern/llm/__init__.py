"""Operators for preparing large-scale training data.

Each module holds one operator with its own general interface; ``queries`` holds the
thin registered queries.  Nothing outside this subpackage imports it.
"""
