"""Relational operators: lines of texts, cases and their documents, checks and reports."""
