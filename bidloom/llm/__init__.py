"""Operators for text problems of large training corpora. Nothing outside this package imports it."""
