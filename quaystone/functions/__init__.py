"""Functions of the table library."""
