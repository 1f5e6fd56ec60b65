"""Column expressions and SQL-visible functions."""
