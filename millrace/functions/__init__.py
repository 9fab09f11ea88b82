"""Column expressions: vectors, long-form matrices and special functions."""
