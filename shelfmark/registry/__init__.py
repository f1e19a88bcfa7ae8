"""Registered queries: each operator run over the given tables, with equivalent SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` is the same result in ANSI SQL."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import browse, duplicate_graph, feeds, history, linking, tagging, texts  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
