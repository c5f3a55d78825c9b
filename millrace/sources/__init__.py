"""Captured traffic as tables and file streams."""
