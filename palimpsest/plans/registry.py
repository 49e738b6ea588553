"""Named queries over the stand-in tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.sources.standins import Standins, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, *, extra: str = "", recursive: bool = False):
    """Register ``fn(standins) -> DataFrame``; ``sql`` may name any stand-in view."""
    def wrap(fn: Callable[[Standins], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Standins(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, extra, recursive)
        return fn
    return wrap


def load_all() -> None:
    from palimpsest.plans import analytics, basics, retrieval, streams, writes  # noqa: F401
