"""Registered queries and the SQL each one is checked with."""

from __future__ import annotations

import importlib

MODULES = [
    "relational", "scalars", "merging", "extraction", "retrieval", "telemetry", "storage",
]


def load() -> tuple[dict, dict]:
    """All queries and their SQL by name."""
    from staylens.catalog import base

    for name in MODULES:
        importlib.import_module(f"staylens.catalog.{name}")
    return base.QUERIES, base.SQL
