"""Ranking, pages and recency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from palimpsest.functions.scoring import as_score
from palimpsest.operators.aggregates import top_per_group
from palimpsest.session import stage


def rank_in_list(ranked: DataFrame, lists: list[str]) -> DataFrame:
    """1-based rank per result list by rounded score, then recency if present, then id.

    A list may hold most of the rows: they are sorted by range over all tasks, counted in each, and every row
    adds the rows of its list in the ranges before.
    """
    order = [F.desc("score")]
    if "created_at" in ranked.columns:
        order.append(F.desc_nulls_last("created_at"))
    spark = ranked.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(ranked.repartitionByRange(parts, *lists, *order, "uuid").withColumn("_part", F.spark_partition_id()))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("_part", *lists).orderBy(*order, "uuid")))
    counts = rows.groupBy("_part", *lists).agg(F.count("*").alias("_n"))  # a row for each list in each range
    before = W.partitionBy(*lists).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("_part", *lists)]
    return rows.alias("r").join(counts.alias("c"), same).select(
        *[F.col(f"r.{c}").alias(c) for c in ranked.columns], (F.col("_nth") + F.col("_before")).cast("int").alias("rank"))


def recent_episodes(episodes: DataFrame, n: int = 5) -> DataFrame:
    return top_per_group(episodes, ["user_id"], [F.desc("created_at"), "uuid"], n)


def recent_context(episodes: DataFrame, n: int = 5, chars: int = 100) -> DataFrame:
    """One text per user listing the newest episodes, each as name and opening of its content."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.substring("content", 1, chars), F.lit("..."))
    few = recent_episodes(episodes.select("user_id", "name", "content", "created_at", "uuid"), n)
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))  # at most n per user
    return few.groupBy("user_id").agg(lines.alias("l")).select(
        "user_id", F.size("l").cast("long").alias("n"),
        F.concat(F.lit("Recent context:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("context"))


def page(df: DataFrame, *, limit: int, offset: int = 0, descending: bool = True,
         sort: str = "created_at", tie: str = "uuid") -> DataFrame:
    order = F.desc(sort) if descending else F.asc(sort)
    return df.orderBy(order, tie).offset(offset).limit(limit)


def list_instructions(instructions: DataFrame, *, agent_type: str | None = None, limit: int = 50) -> DataFrame:
    if agent_type:
        instructions = instructions.filter(F.col("agent_type") == agent_type)
    return instructions.orderBy(F.desc("updated_at"), "uuid").limit(limit)


def topk_by_score_recency(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    df = df.withColumn("score", as_score(F.col("score")))
    return top_per_group(df, keys, [F.desc("score"), F.desc_nulls_last("created_at"), "uuid"], limit)
