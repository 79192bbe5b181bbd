"""Registered queries (name -> function of (spark, sf_dir)) and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the SQL that DuckDB runs on the same tables."""

    def keep(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def _load() -> None:
    from . import queries_library, queries_more, queries_ops, queries_search, queries_sources, queries_text  # noqa: F401


_load()
