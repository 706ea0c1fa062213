"""Scans and sinks for the source formats."""
