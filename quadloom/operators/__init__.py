"""Relational operators of mappings."""
