"""Column functions: text forms and parsers."""
