"""Column functions of keys, times, amounts and records."""
