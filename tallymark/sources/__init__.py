"""Readers and writers of the record streams."""
