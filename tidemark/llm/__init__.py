"""Operators for preparing language-model training data.

Ten operators, each in its own module, plus ``registry`` with their queries
and SQL.  Nothing outside this subpackage imports it.
"""
