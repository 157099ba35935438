"""Extras over streams."""
