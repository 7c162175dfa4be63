"""Operators for preparing training text: scoring, privacy, formatting, tokens, duplicates, search, quality."""
