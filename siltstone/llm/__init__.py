"""Operators over text corpora."""
