"""Fixtures and the registered query catalog."""
