"""Column expressions: text, titles, tokens, vectors."""
