"""Column functions: text, markup and geometry."""
