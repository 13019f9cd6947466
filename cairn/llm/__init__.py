"""Operators that prepare training text: deduplication, filters, extraction, mixing, tokens."""
