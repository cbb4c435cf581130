"""Column functions: fixed values, patterns, text and geometry."""
