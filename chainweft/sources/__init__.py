"""Readers, writers and the mapping from supplied tables to canonical frames."""
