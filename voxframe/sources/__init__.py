"""Readers, writers and test volumes."""
