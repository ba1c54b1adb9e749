"""Positions, closing values and market values, as DataFrame functions."""
