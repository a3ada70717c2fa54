"""Operators for preparing training text: search, extraction, counting, filtering, deduplication, mixing, encoding, scoring."""
