"""Named queries over the given tables, and their SQL equivalents."""

from __future__ import annotations

import importlib
import pkgutil

from threadlens.queries import registry


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


def all_queries():
    _load()
    return dict(registry.QUERIES)


def all_sql():
    _load()
    return dict(registry.SQL)
