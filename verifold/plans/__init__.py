"""Whole jobs: extraction of fields from texts, rule families, reports."""
