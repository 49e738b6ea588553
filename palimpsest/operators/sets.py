"""Set operations on lists and on result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from palimpsest.functions.text import normalize_entity_name


def merge_episode_lists(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))


def union_lists(lists: list[DataFrame]) -> DataFrame:
    """Stack result lists, numbered in order."""
    out = None
    for i, df in enumerate(lists):
        part = df.withColumn("list_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_results(lists: list[DataFrame], payload: list[str]) -> DataFrame:
    """One row per (query, kind, uuid): scores add up, the later list's payload wins."""
    rows = union_lists(lists)
    return rows.groupBy("query_id", "kind", "uuid").agg(
        F.sum("score").alias("score"),
        *[F.max_by(c, "list_no").alias(c) for c in payload],
        F.count("*").alias("n_lists"))


def dedup_names(df: DataFrame, *, document: str, name: str, position: str) -> DataFrame:
    """First occurrence of each normalised name in a document."""
    norm = df.withColumn("normalized", normalize_entity_name(F.col(name)))
    first = F.row_number().over(W.partitionBy(document, "normalized").orderBy(position))
    return norm.withColumn("rn", first).filter("rn = 1").drop("rn")
