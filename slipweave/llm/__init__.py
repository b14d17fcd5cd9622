"""Operators for large training-text tables. Nothing outside imports this package."""
