"""Operators for preparing training text: deduplication, tokenization, cleaning, packing and formatting.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
