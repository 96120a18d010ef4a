"""Operators for preparing training text: cleaning, deduplication, mixing and tokens."""
