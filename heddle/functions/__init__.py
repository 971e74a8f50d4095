"""Column expressions and batch functions."""
