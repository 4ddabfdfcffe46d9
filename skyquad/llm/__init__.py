"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it: it can be deleted and the rest of
the library still imports and runs.
"""
