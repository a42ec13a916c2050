"""Operators that prepare training text: quality, toxicity, duplicates, mixing, packing, extraction, search."""
