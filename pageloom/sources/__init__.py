"""Readers and writers for stored pages, run directories and run records."""
