"""Streaming of the table library."""
