"""Column -> Column building blocks (no shuffle, no Python workers)."""
