"""All registered queries in one place (registry plus model/stream/job queries)."""

from __future__ import annotations


def _entries() -> dict:
    from .jobs import JOBS
    from .registry import REGISTRY
    return {**REGISTRY, **JOBS}


def all_queries() -> dict:
    return {k: fn for k, (fn, _) in _entries().items()}


def all_sql() -> dict:
    return {k: sql for k, (_, sql) in _entries().items() if sql}
