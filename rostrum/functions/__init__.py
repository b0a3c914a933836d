"""Column -> Column functions; none needs a Python worker."""
