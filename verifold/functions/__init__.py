"""Column functions: text, identifiers, money, dates. All are native expressions."""
