"""All registered queries and their oracles, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a query; ``oracle`` is DuckDB SQL with the same columns and rows."""

    def wrap(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return wrap


from trendlake.plans import catalogue, growth, labels, operations  # noqa: E402,F401
