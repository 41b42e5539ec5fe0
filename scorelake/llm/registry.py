"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

from scorelake.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def load_queries() -> None:
    import_module("scorelake.llm.queries")
