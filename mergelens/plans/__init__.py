"""Whole queries: metrics, ratings and reports for all subjects at once."""
