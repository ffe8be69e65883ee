"""Column expressions; all of them are built-in functions, no UDF."""
