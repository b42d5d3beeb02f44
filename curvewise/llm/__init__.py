"""Operators for preparing training text: deduplication, search, filters, packing, scoring."""
