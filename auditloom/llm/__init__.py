"""Operators for text and code corpora. Nothing outside this package imports it."""
