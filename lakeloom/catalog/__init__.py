"""The library's queries and their SQL, by name."""

from __future__ import annotations

from lakeloom.catalog import lines, pages, plans, ranking, scan, search, urls  # noqa: F401
from lakeloom.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
