"""Column functions: text, arrays, keys."""
