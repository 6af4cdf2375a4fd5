"""Filters, hierarchies, access rules and frame helpers."""
