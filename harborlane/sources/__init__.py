"""Readers: files, tables, topics and the views over the driver tables."""
