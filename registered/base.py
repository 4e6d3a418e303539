"""Registration of a query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from stowage.inventory_views import duckdb_text

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

# 2024-01-15 12:00:00 UTC, the fixed "now" of every dated query.
NOW_MS = 1_705_320_000_000
# 2001-06-15 12:00:00 UTC, inside the date range of lineitem.
NOW_LI_MS = 992_606_400_000


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def using(views: str, body: str, *, recursive: bool = False, **more: str) -> str:
    """``body`` with the named inventory views (and extra named steps) in front of it."""
    steps = [(v, duckdb_text(v)) for v in views.split()] + list(more.items())
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{n} as ({text})" for n, text in steps) + "\n" + body
