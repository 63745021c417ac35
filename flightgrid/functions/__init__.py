"""Column expressions, without UDFs."""
