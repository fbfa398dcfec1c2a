"""Column expressions and distribution statistics."""
