"""Queries over the given tables and end-to-end jobs."""
