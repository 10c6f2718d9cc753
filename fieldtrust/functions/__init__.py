"""Column expressions: text, paths and boxes."""
