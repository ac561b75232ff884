"""Column-level building blocks: dates, numbers, text and hashes."""
