"""Where queries register themselves with the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a (spark, sf_dir) query under ``name`` or its function's, with its SQL if SQL can say it."""

    def register(fn: Callable) -> Callable:
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return register
