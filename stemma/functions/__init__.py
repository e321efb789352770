"""Column functions; all are built-in expressions."""
