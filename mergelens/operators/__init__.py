"""Relational operators over raw and canonical tables."""
