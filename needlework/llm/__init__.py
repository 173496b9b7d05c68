"""Operators for preparing training text, each usable on any table of documents."""
