"""Scans, script datasets, sinks and model suggestion."""
