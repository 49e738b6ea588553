"""Pruning, cascading deletes and compaction.  Deletes are anti joins; results are new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators import filters
from palimpsest.operators.joins import orphan_entities
from palimpsest.operators.skew import broadcast_if_small
from palimpsest.operators.vectors import CHUNK_ROWS, greedy_keep
from palimpsest.session import stage


def _before(reference_time, days: int) -> Column:
    if days < 1:
        raise ValueError("ages are at least one day")
    return F.lit(reference_time).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")


def drop_incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without an endpoint in ``nodes(uuid)``."""
    gone = nodes.select(F.col(nodes.columns[0]).alias("uuid")).distinct()
    return (edges.join(gone.withColumnRenamed("uuid", "source_uuid"), "source_uuid", "left_anti")
            .join(gone.withColumnRenamed("uuid", "target_uuid"), "target_uuid", "left_anti"))


def _of_user(edges: DataFrame, entities: DataFrame | None, user_id: str | None) -> DataFrame:
    """Edges whose both endpoints are the user's, as ``uuid``."""
    if user_id and entities is None:
        raise ValueError("a user's edges are found by the table of entities")
    if entities is None:
        return edges
    mine = filters.by_user(entities, user_id).select("uuid")
    return (edges.join(mine.withColumnRenamed("uuid", "source_uuid"), "source_uuid", "left_semi")
            .join(mine.withColumnRenamed("uuid", "target_uuid"), "target_uuid", "left_semi"))


def prune_expired_edges(edges: DataFrame, *, reference_time, cutoff_days: int = 90, user_id: str | None = None,
                        entities: DataFrame | None = None) -> DataFrame:
    old = F.coalesce(F.col("expired_at") < _before(reference_time, cutoff_days), F.lit(False))
    if not user_id:
        return edges.filter(~old)
    return edges.join(_of_user(edges.filter(old), entities, user_id).select("uuid"), "uuid", "left_anti")


def prune_low_mention_entities(entities: DataFrame, edges: DataFrame, mentions: DataFrame, *, reference_time,
                               min_mentions: int = 2, min_age_days: int = 30, user_id: str | None = None
                               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Old, rarely mentioned entities go with their edges and mentions."""
    if min_mentions < 1:
        raise ValueError("min_mentions is at least one")
    weak = (F.col("mentions") < min_mentions) & (F.col("created_at") < _before(reference_time, min_age_days))
    if user_id:
        weak = weak & (F.col("user_id") == user_id)
    weak = F.coalesce(weak, F.lit(False))
    gone = entities.filter(weak).select("uuid")
    return (entities.filter(~weak), drop_incident(edges, gone),
            mentions.join(gone.withColumnRenamed("uuid", "entity_uuid"), "entity_uuid", "left_anti"))


def redundant_edges(edges: DataFrame, *, threshold: float = 0.95, chunk_rows: int = CHUNK_ROWS, among: DataFrame | None = None) -> DataFrame:
    """``id, keeper, score`` within each unordered endpoint pair, in order of creation.

    ``among`` (as of ``edge_ends``): the edges to look at, all if not given.
    """
    ends = edge_ends(edges) if among is None else among
    ends = ends.select("uuid", "has_vector", F.least("source_uuid", "target_uuid").alias("_a"), F.greatest("source_uuid", "target_uuid").alias("_b"))
    # Only pairs with at least two vectors have anything to compare; they are found by ids, so that other vectors stay where they are.
    several = ends.filter("has_vector").groupBy("_a", "_b").agg(F.count("*").alias("n")).filter("n > 1")
    wanted = stage(ends.join(several.drop("n"), ["_a", "_b"], "left_semi").select("uuid"))
    pair = edges.join(broadcast_if_small(wanted), "uuid", "left_semi").select(
        "uuid", "created_at", "fact_embedding", F.least("source_uuid", "target_uuid").alias("_a"), F.greatest("source_uuid", "target_uuid").alias("_b"))
    return greedy_keep(pair, block=["_a", "_b"], ident="uuid", ts="created_at", vector="fact_embedding",
                       threshold=threshold, chunk_rows=chunk_rows)


def edge_ends(edges: DataFrame) -> DataFrame:
    """What pruning decides by, without texts, lists and vectors."""
    return edges.select("uuid", "source_uuid", "target_uuid", "expired_at", F.coalesce(F.size("fact_embedding") > 0, F.lit(False)).alias("has_vector"))


def compact_redundant_edges(edges: DataFrame, *, threshold: float = 0.95, user_id: str | None = None,
                            entities: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Merge near-duplicate facts into the earliest: mentions add up, episode lists unite."""
    scope = _of_user(edges, entities, user_id) if user_id else edges
    return _united(edges, redundant_edges(scope, threshold=threshold, chunk_rows=chunk_rows).filter("id <> keeper"))


def _united(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """``edges`` with those in ``merged`` (``id, keeper``) put into their keepers."""
    into = edges.select(F.col("uuid").alias("id"), "mentions", "episodes").join(merged, "id").groupBy(
        F.col("keeper").alias("uuid")).agg(
        F.sum("mentions").alias("_m"), F.array_distinct(F.flatten(F.collect_set("episodes"))).alias("_e"))
    kept = edges.join(merged.select(F.col("id").alias("uuid")), "uuid", "left_anti")
    none = F.array().cast("array<string>")
    return kept.join(into, "uuid", "left").withColumns({
        "mentions": F.col("mentions") + F.coalesce("_m", F.lit(0)),
        "episodes": F.when(F.col("_e").isNull(), F.col("episodes")).otherwise(
            F.array_sort(F.array_union(F.coalesce("episodes", none), F.col("_e"))))}).drop("_m", "_e")


def prune_all(entities: DataFrame, edges: DataFrame, mentions: DataFrame, *, reference_time, user_id: str | None = None,
              expired_cutoff_days: int = 90, min_mentions: int = 2, min_age_days: int = 30,
              compact_redundant: bool = True, threshold: float = 0.95) -> tuple[dict[str, DataFrame], DataFrame]:
    """Expired facts, then weak entities, then redundant facts; new tables and one row of counts."""
    # Which edges stay is decided by their ends; each step's are written once, for the next one and its count.
    ends = stage(edge_ends(edges))
    e1 = stage(prune_expired_edges(ends, reference_time=reference_time, cutoff_days=expired_cutoff_days, user_id=user_id, entities=entities))
    n2, e2, m2 = prune_low_mention_entities(entities, e1, mentions, reference_time=reference_time,
                                            min_mentions=min_mentions, min_age_days=min_age_days, user_id=user_id)
    n2, e2 = stage(n2), stage(e2)
    left = edges.join(e2.select("uuid"), "uuid", "left_semi")
    merged_count = F.lit(0).cast("long")

    def n(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    if compact_redundant:
        scope = _of_user(e2, n2, user_id) if user_id else e2
        merged = stage(redundant_edges(edges, threshold=threshold, among=scope).filter("id <> keeper"))
        left = _united(left, merged)
        merged_count = n(e2.join(merged.select(F.col("id").alias("uuid")), "uuid", "left_semi"))
    counts = ends.agg(F.count("*").alias("before")).select(
        (F.col("before") - n(e1)).alias("expired_edges_deleted"), (n(entities) - n(n2)).alias("entities_deleted"),
        merged_count.alias("edges_merged"))
    return {"entities": n2, "edges": left, "mentions": m2}, counts


def delete_user(episodes: DataFrame, entities: DataFrame, edges: DataFrame, mentions: DataFrame, user_id: str
                ) -> dict[str, DataFrame]:
    """Remove everything of one user and all that touches it."""
    mine = F.coalesce(F.col("user_id") == user_id, F.lit(False))
    eps, ents = episodes.filter(mine).select("uuid"), entities.filter(mine).select("uuid")
    return {
        "episodes": episodes.filter(~mine), "entities": entities.filter(~mine), "edges": drop_incident(edges, ents),
        "mentions": mentions.join(eps.withColumnRenamed("uuid", "episode_uuid"), "episode_uuid", "left_anti")
                            .join(ents.withColumnRenamed("uuid", "entity_uuid"), "entity_uuid", "left_anti"),
    }


def delete_instructions(instructions: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The remaining instructions, and for each requested id whether it existed."""
    have = instructions.select("uuid", F.lit(True).alias("deleted"))
    report = keys.select("uuid").distinct().join(have, "uuid", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return instructions.join(keys.select("uuid"), "uuid", "left_anti"), report


def reset_graph(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: df.filter(F.lit(False)) for name, df in tables.items()}


def delete_episodes(episodes: DataFrame, entities: DataFrame, edges: DataFrame, mentions: DataFrame, deleted: DataFrame
                    ) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove episodes, the entities only they mention, and those entities' facts; with counts."""
    gone = deleted.select("uuid").distinct()
    orphans = orphan_entities(mentions, gone).withColumnRenamed("entity_uuid", "uuid")
    out = {
        "episodes": episodes.join(gone, "uuid", "left_anti"), "entities": entities.join(orphans, "uuid", "left_anti"),
        "edges": drop_incident(edges, orphans),
        "mentions": mentions.join(gone.withColumnRenamed("uuid", "episode_uuid"), "episode_uuid", "left_anti"),
    }

    def n(df: DataFrame) -> Column:
        return df.agg(F.count("*").alias("n")).scalar()

    counts = episodes.agg(F.count("*").alias("before")).select(
        (F.col("before") - n(out["episodes"])).alias("episodes_deleted"),
        (n(entities) - n(out["entities"])).alias("entities_deleted"),
        (n(edges) - n(out["edges"])).alias("edges_deleted"))
    return out, counts
