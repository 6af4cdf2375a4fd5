"""Logical types, field names, expressions and helper functions."""
