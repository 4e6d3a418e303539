"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from registered.base import QUERIES, SQL

for _part in ("files", "projects", "plans", "checks", "live", "stored", "compare", "runs"):
    import_module(f"registered.{_part}")

__all__ = ["QUERIES", "SQL"]
