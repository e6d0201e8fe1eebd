"""Column-expression libraries: text, scoring and token arithmetic."""
