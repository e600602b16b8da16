"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` holds the registered
query of each operator and its SQL.
"""
