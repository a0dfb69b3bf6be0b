"""All queries of this subpackage."""

from __future__ import annotations

import importlib

from threadlens.llm import registry

MODULES = ["query_lines", "query_models", "query_text", "query_near", "query_suffix", "query_tokens", "query_phrases"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"threadlens.llm.{name}")


def all_queries():
    _load()
    return dict(registry.QUERIES)


def all_sql():
    _load()
    return dict(registry.SQL)
