"""Hash functions, as columns and on arrays."""
