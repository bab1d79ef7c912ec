"""Column expressions of inclusion dependencies."""
