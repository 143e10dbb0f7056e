"""Operators for large training-text tables. Nothing else in the library imports this subpackage."""
