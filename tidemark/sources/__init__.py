"""Readers and writers of source trees, verdict files and small artifacts."""
