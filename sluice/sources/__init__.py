"""Readers, writers and schema rules for tabular files."""
