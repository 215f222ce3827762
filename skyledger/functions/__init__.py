"""Column expressions: physical indices, cleaning helpers, geometry."""
