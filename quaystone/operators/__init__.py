"""Operators of the table library."""
