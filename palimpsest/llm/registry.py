"""Queries of this subpackage by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def load_all() -> None:
    from palimpsest.llm import (  # noqa: F401
        chunk_prints,
        dart_minhash,
        dot_clusters,
        fm_decontaminate,
        jaccard_join,
        kneser_ney,
        license_rules,
        monoid_bpe,
        prefix_counts,
        sharding,
        toxicity,
        turn_repair,
        warc,
    )
