"""Incremental pick-up of newly arrived raw files."""
