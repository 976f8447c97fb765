"""Operators for building training data from large text corpora.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
