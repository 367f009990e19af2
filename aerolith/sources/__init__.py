"""Readers of tables and of the file formats of the domain."""
