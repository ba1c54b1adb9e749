"""The same results on streams."""
