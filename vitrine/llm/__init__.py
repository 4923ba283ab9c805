"""Operators that prepare training text: scoring, duplicates, mixing, tokens, shards, search.

Nothing else in the library imports this subpackage.
"""
