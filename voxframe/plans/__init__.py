"""Whole tasks, and the registered queries with their SQL."""
