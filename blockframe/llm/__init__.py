"""Operators for large text corpora. Nothing else in this library imports them."""
