"""Column expressions and window frames."""
