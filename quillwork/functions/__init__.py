"""Column functions: text patterns, JSON, vectors."""
