"""Counts, distinct lists and coverage.  Every groupBy here combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def graph_stats(episodes: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
           for name, df in (("episodes", episodes), ("entities", entities), ("relationships", edges))]
    return one[0].unionByName(one[1]).unionByName(one[2])


def index_stats(**corpora: DataFrame) -> DataFrame:
    """Documents and tokens per keyword corpus; each corpus has columns ``uuid, tokens``."""
    parts = [df.agg(F.count("*").alias("documents"), F.sum(F.size("tokens")).alias("tokens")).select(
        F.lit(name).alias("corpus"), "documents", "tokens") for name, df in corpora.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_users(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("user_id").distinct()
    for t in tables[1:]:
        out = out.union(t.select("user_id").distinct())
    return out.filter(F.col("user_id").isNotNull()).distinct().orderBy("user_id")


def distinct_entity_types(entities: DataFrame) -> DataFrame:
    return entities.select("entity_type").filter(F.col("entity_type") != "").distinct().orderBy("entity_type")


def entity_type_distribution(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type")


def embedding_coverage(df: DataFrame, column: str) -> DataFrame:
    has = F.coalesce(F.size(column) > 0, F.lit(False))
    return df.agg(F.count("*").alias("total"), F.count_if(has).alias("with_embedding"))


def instructions_by_agent_type(instructions: DataFrame) -> DataFrame:
    """Per agent type: number of instructions and the newest; lists stay in the table itself."""
    newest = F.max(F.struct("updated_at", "uuid"))
    return instructions.groupBy("agent_type").agg(
        F.count("*").alias("n"), F.count_if("memory_enabled").alias("memory_enabled"), newest.alias("m")
    ).select("agent_type", "n", "memory_enabled", F.col("m.uuid").alias("newest_uuid"),
             F.col("m.updated_at").alias("newest_at"))


def time_saved(metrics: DataFrame, *, used: str = "used_memory", saved: str = "time_saved") -> DataFrame:
    value = F.when(F.col(used), F.col(saved))
    return metrics.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_saved"),
                       F.coalesce(F.sum(value), F.lit(0.0)).alias("total_saved"),
                       F.count(value).alias("n"))


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def graph_payload(entities: DataFrame, edges: DataFrame, *, node_limit: int = 1000,
                  edge_limit: int = 2000) -> DataFrame:
    """Nodes and edges of a drawing, each limited (that is the feature), with full counts."""
    n_nodes, n_edges = (df.agg(F.count("*").alias("n")) for df in (entities, edges))
    nodes = entities.orderBy(F.desc("mentions"), "uuid").limit(node_limit).select(
        F.lit("node").alias("part"), "uuid", F.col("name").alias("label"),
        F.lit(None).cast("string").alias("source_uuid"), F.lit(None).cast("string").alias("target_uuid"),
        n_nodes.scalar().alias("total"))
    links = edges.orderBy(F.desc("mentions"), "uuid").limit(edge_limit).select(
        F.lit("edge").alias("part"), "uuid", F.col("name").alias("label"), "source_uuid", "target_uuid",
        n_edges.scalar().alias("total"))
    return nodes.unionByName(links)


def top_per_group(df: DataFrame, keys: list[str], order: list, limit: int | None, rank: str = "rank") -> DataFrame:
    """Top rows per group (all of them, ranked, without a limit).

    Spark limits each group inside every task before it shuffles.
    """
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked if limit is None else ranked.filter(F.col(rank) <= limit)
