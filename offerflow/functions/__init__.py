"""Column expressions: no shuffles, no Python in the row path."""
