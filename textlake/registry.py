"""All registered queries (spark, sf_dir) -> DataFrame and their DuckDB equivalents, once ``load`` has run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with its DuckDB SQL if it has one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def load() -> None:
    """Imports every module that registers queries."""
    from textlake.plans import books, catalog, ingest, layout, library, search, sources, streams, text  # noqa: F401

