"""All registered queries of the subpackage, with SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from stowage.llm import (
    decontamination, licenses, mixing, multi_index, periodic, quality, sharding, signature_join, simhash_dedup, spelling,
    substring_dedup, suffix_dedup, token_counts,
)
from stowage.llm.tables import reachable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
for _module in (substring_dedup, token_counts, mixing, multi_index, decontamination, licenses, suffix_dedup, sharding,
                quality, simhash_dedup, spelling, signature_join, periodic):
    QUERIES.update({name: reachable(query) for name, query in _module.QUERIES.items()})
    SQL.update(_module.SQL)
