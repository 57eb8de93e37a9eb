"""User-defined functions."""
