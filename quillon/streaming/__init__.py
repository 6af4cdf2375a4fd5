"""Event-time queries over streams."""
