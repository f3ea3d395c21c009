"""Relational operators of the document pipeline."""
