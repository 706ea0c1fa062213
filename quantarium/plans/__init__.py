"""Composed models, and the registered queries with their SQL."""

from __future__ import annotations

from . import lookups, models, prices, profiles, scans, shapes, streams, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "lookups", "models", "prices", "profiles", "scans", "shapes", "streams", "texts"]
