"""Jobs: read tables, run operators over all months at once, write tables."""
