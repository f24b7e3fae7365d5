"""Readers and writers of files and tables."""
