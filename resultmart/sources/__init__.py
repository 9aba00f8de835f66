"""Readers, writers and schemas of the tables."""
