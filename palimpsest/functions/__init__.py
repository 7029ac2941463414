"""Column expressions built from native Spark functions."""
