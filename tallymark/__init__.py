"""Positions, market values and training-data operators on Spark."""
