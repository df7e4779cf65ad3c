"""Column expressions: ids, numbers, text, dense vectors."""
