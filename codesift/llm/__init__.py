"""Operators for preparing training text: filters, deduplication, sharding and token counts."""
