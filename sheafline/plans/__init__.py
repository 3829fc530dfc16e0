"""Named queries over the driver's tables, and their SQL for a second engine."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES, Query

MODULES = ("retrieval", "filters", "grounding", "tables", "store")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
