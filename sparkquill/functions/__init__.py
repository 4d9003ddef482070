"""Column expressions: text, token classes, phrases, stemming."""
