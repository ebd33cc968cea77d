"""Readers of files and databases, and writers."""
