"""Query registry used by ``__spark_entry__``.

``@register(name, oracle)`` records a Spark plan and, where SQL can state the
same result, the DuckDB oracle.  Plans are grouped by theme in sibling modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def _load_all() -> None:
    # Import for side effects (registration).
    from . import (q_alerts, q_code, q_extract, q_languages, q_search, q_sources, q_state, q_stats,  # noqa: F401
                   q_streams, q_vectors)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
