"""Column expressions: text handling, pattern hits, risk classes."""
