"""The same work over streams."""
