"""Column expressions and parameters of the dip search."""
