"""Operators for large training corpora of text; nothing outside this folder imports it."""
