"""Readers and writers of files that Spark has no format for."""
