"""Structured Streaming forms of operators whose inputs grow."""
