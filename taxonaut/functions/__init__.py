"""Column functions: text, identifiers, arrays."""
