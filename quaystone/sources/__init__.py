"""Sources of the table library."""
