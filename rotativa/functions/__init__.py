"""Column expressions: dates, text, URLs and vectors."""
