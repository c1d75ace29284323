"""Column expressions: no shuffles, no Python on rows except the model calls."""
