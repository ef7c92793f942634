"""The registry of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "r04_hybrid_rrf"
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query function, with its SQL if there is one."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from memspark.plans import corpus, recall, writing  # noqa: F401  they register their queries


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
