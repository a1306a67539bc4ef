"""Plans of the table library."""
