"""Keyed upserts.  A batch is first reduced to one update per key, then merged with the stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators.sets import merge_episode_lists
from palimpsest.operators.skew import BROADCAST_ROWS, is_small
from palimpsest.session import stage


def latest(updates: DataFrame, keys: list[str], *, at: str = "created_at", tie: str = "uuid", **extra: Column) -> DataFrame:
    """One row per key: the latest update by (time, id), plus aggregates over all updates of the key.

    Updates that tie in both are told apart by a hash of the row, so that a task that runs again gives the same.
    """
    rest = [c for c in updates.columns if c not in keys]
    plain = [f.name for f in updates.schema if f.name in rest and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    kept = [c for c in rest if c not in extra]  # what is aggregated anyway does not travel twice
    newest = F.max_by(F.struct(*kept), F.struct(at, *[tie] * (tie in rest), F.xxhash64(*plain)))
    out = updates.groupBy(*keys).agg(newest.alias("_n"), *[v.alias(f"_x_{k}") for k, v in extra.items()])
    return out.select(*keys, *[F.col(f"_n.{c}").alias(c) for c in kept],
                      *[F.col(f"_x_{k}").alias(k) for k in extra])


def merge(target: DataFrame, updates: DataFrame, keys: list[str], on_match: dict[str, str | Column]) -> DataFrame:
    """Stored rows merged with one update per key.

    ``on_match`` gives for a column what a matched row gets: ``"new"`` (the update's value),
    ``"new_if_set"``, or an expression over ``t.col`` and ``u.col``; columns not named keep the old
    value.  Unmatched updates are inserted as they are.
    """
    cond = [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    updates = stage(updates)
    t, u = target.withColumn("_t", F.lit(True)).alias("t"), updates.withColumn("_u", F.lit(True)).alias("u")
    if is_small(updates, BROADCAST_ROWS):
        # A bounded batch goes to the stored rows, which are then read but never shuffled.
        known = target.select(*keys).alias("t").join(F.broadcast(u), cond, "left_semi").distinct()
        fresh = updates.alias("u").join(F.broadcast(known.alias("t")), cond, "left_anti")
        types = dict(target.dtypes)
        inserts = fresh.select(*[(F.col(c) if c in updates.columns else F.lit(None)).cast(types[c]).alias(c)
                                 for c in target.columns])
        return _changed(t.join(F.broadcast(u), cond, "left"), target, updates, on_match).unionByName(inserts)
    return _changed(t.join(u, cond, "full_outer"), target, updates, on_match)


def _changed(both: DataFrame, target: DataFrame, updates: DataFrame, on_match: dict[str, str | Column]) -> DataFrame:
    """The joined rows with ``on_match`` applied."""
    matched = F.col("_t").isNotNull() & F.col("_u").isNotNull()
    types = dict(target.dtypes)
    cols = []
    for c in target.columns:
        old = F.col(f"t.{c}")
        new = F.col(f"u.{c}") if c in updates.columns else F.lit(None)
        rule = on_match.get(c)
        if isinstance(rule, Column):
            hit = rule
        else:
            hit = {None: old, "new": new, "new_if_set": F.coalesce(new, old)}[rule]
        cols.append(F.when(F.col("_t").isNull(), new).when(matched, hit).otherwise(old).cast(types[c]).alias(c))
    return both.select(*cols)


def upsert_episodes(target: DataFrame, updates: DataFrame) -> DataFrame:
    """A known episode gets its edge list, vector and kind; content and metadata stay."""
    return merge(target, latest(updates, ["uuid"], tie="kind"), ["uuid"],
                 {"entity_edges": "new", "content_embedding": "new", "kind": "new"})


def upsert_entities(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Mentions add up over the batch; summary and attributes are replaced, a vector only by a vector."""
    one = latest(updates, ["uuid"], tie="name", mentions=F.sum("mentions"))
    return merge(target, one, ["uuid"], {
        "mentions": F.col("t.mentions") + F.col("u.mentions"), "summary": "new", "attributes": "new",
        "name_embedding": "new_if_set"})


def upsert_edges(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Mentions add up, fact and vector are replaced, episodes unite, times stay."""
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_set("episodes"))))
    one = latest(updates, ["uuid"], tie="fact", mentions=F.sum("mentions"), episodes=lists)
    return merge(target, one, ["uuid"], {
        "mentions": F.col("t.mentions") + F.col("u.mentions"), "fact": "new", "fact_embedding": "new",
        "attributes": "new", "episodes": merge_episode_lists(F.col("t.episodes"), F.col("u.episodes"))})


def upsert_mentions(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Known links are left alone, new ones are added once."""
    new = latest(updates, ["uuid"], tie="episode_uuid").select(*target.columns)
    return target.unionByName(new.join(target.select("uuid"), "uuid", "left_anti"))


def upsert_tools(target: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New target, and counts of tools saved, updated and failed (no name)."""
    named = updates.filter(F.coalesce(F.col("tool_name"), F.lit("")) != "")
    one = latest(named, ["tool_name"], mentions=F.count("*"))
    rules = {"mentions": F.col("t.mentions") + F.col("u.mentions"), "description": "new"}
    if "name_embedding" in target.columns:
        rules["name_embedding"] = "new_if_set"
    known = target.select("tool_name", F.lit(1).alias("known"))
    counts = named.select("tool_name").distinct().join(known, "tool_name", "left").agg(
        F.count_if(F.col("known").isNull()).alias("saved"), F.count("known").alias("updated"))
    failed = updates.agg(F.count_if(F.coalesce(F.col("tool_name"), F.lit("")) == "").alias("n"))
    return (merge(target, one, ["tool_name"], rules),
            counts.withColumn("failed", failed.scalar()))


def upsert_instructions(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Keyed by agent type and base text: the other fields are replaced, creation data stay."""
    keys = ["agent_type", "base_instruction"]
    keep = {*keys, "uuid", "created_at"}
    one = latest(updates, keys, at="updated_at")
    return merge(target, one, keys, {c: "new" for c in target.columns if c not in keep})
