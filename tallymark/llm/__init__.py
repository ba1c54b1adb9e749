"""Operators for large training-data tables: text, URL and vector work."""
