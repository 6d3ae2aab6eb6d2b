"""Operators that prepare training text: filters, deduplication, mixing, packing, output."""
