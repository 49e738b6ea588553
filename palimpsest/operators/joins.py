"""Graph joins.  No side is force-broadcast: adaptive execution measures and decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from palimpsest import schema
from palimpsest.operators.filters import active_edges


def episode_entities(episodes: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    m = mentions.select("episode_uuid", "entity_uuid").distinct()
    e = entities.select(F.col("uuid").alias("entity_uuid"), F.col("name").alias("entity_name"), "entity_type")
    return (m.join(episodes.select(F.col("uuid").alias("episode_uuid")), "episode_uuid", "left_semi")
            .join(e, "entity_uuid"))


def triggered_episodes(episodes: DataFrame, triggered: DataFrame, *, source: str | None = None,
                       limit: int = 10) -> DataFrame:
    """Per triggering episode its newest triggered episodes that carry metadata."""
    right = episodes.filter(F.col("metadata").isNotNull())
    if source:
        right = right.filter(F.col("source") == source)
    joined = triggered.select(F.col("source_uuid").alias("trigger_uuid"), F.col("target_uuid").alias("uuid")).join(
        right.select("uuid", "name", "source", "kind", "created_at"), "uuid")
    rank = F.row_number().over(W.partitionBy("trigger_uuid").orderBy(F.desc("created_at"), "uuid"))
    return joined.withColumn("rank", rank).filter(F.col("rank") <= limit)


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a self-loop appears once."""
    out = edges.select(F.col("source_uuid").alias("node"), F.col("target_uuid").alias("other"),
                       F.col("uuid").alias("edge_uuid"))
    back = edges.filter(F.col("source_uuid") != F.col("target_uuid")).select(
        F.col("target_uuid").alias("node"), F.col("source_uuid").alias("other"),
        F.col("uuid").alias("edge_uuid"))
    return out.unionByName(back)


def entity_relationships(entities: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, *,
                         include_expired: bool = False, reference_time=None) -> DataFrame:
    """Edges seen from either endpoint with the other node's name; ``seeds`` limits the nodes."""
    live = edges if include_expired else active_edges(edges, reference_time)
    cols = ("name", "fact", "valid_at", "invalid_at", "expired_at")
    fwd = live.select(F.col("source_uuid").alias("entity_uuid"), F.col("target_uuid").alias("other_uuid"),
                      F.col("uuid").alias("edge_uuid"), *cols, F.lit("outgoing").alias("direction"))
    rev = live.filter(F.col("source_uuid") != F.col("target_uuid")).select(
        F.col("target_uuid").alias("entity_uuid"), F.col("source_uuid").alias("other_uuid"),
        F.col("uuid").alias("edge_uuid"), *cols, F.lit("incoming").alias("direction"))
    adj = fwd.unionByName(rev).withColumnRenamed("name", "relation_type")
    if seeds is not None:
        adj = adj.join(seeds.select(F.col(seeds.columns[0]).alias("entity_uuid")), "entity_uuid", "left_semi")
    other = entities.select(F.col("uuid").alias("other_uuid"), F.col("name").alias("other_name"),
                            F.col("entity_type").alias("other_type"))
    return adj.join(other, "other_uuid")


def edges_with_names(edges: DataFrame, entities: DataFrame, missing: str = "Unknown") -> DataFrame:
    """Endpoint names; pass only the entities of a result set and ``missing=''`` for its own names."""
    def names(side: str) -> DataFrame:
        return entities.select(F.col("uuid").alias(f"{side}_uuid"), F.col("name").alias(f"{side}_name"))

    out = edges.join(names("source"), "source_uuid", "left").join(names("target"), "target_uuid", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(missing)) for c in ("source_name", "target_name")})


def edge_direction_counts(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edges per entity (pre-aggregated before the shuffle)."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source_uuid").alias("entity_uuid"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("target_uuid").alias("entity_uuid"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.select("e.*").groupBy("entity_uuid").agg(
        F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def orphan_entities(mentions: DataFrame, deleted: DataFrame) -> DataFrame:
    """Entities mentioned by deleted episodes and by no other: one grouped pass, no self join."""
    d = deleted.select(F.col(deleted.columns[0]).alias("episode_uuid"), F.lit(1).alias("gone")).distinct()
    flagged = mentions.select("episode_uuid", "entity_uuid").join(d, "episode_uuid", "left")
    return flagged.groupBy("entity_uuid").agg(F.count("gone").alias("hit"), F.count("*").alias("n")).filter(
        (F.col("hit") > 0) & (F.col("hit") == F.col("n"))).select("entity_uuid")


def neighbor(df: DataFrame, *, keys: list[str], ts: str, ident: str, direction: str = "previous") -> DataFrame:
    """Each row with ``other``: the (t, id) of the previous or next row of its key in time order.

    The work goes level by level so that no level holds a whole key: the neighbour within the same
    second, else the nearest second of the same day, else the nearest day with rows.
    """
    move, nearest = (F.lag, F.max) if direction == "previous" else (F.lead, F.min)
    micros = F.unix_micros(ts)
    rows = df.select(*keys, F.col(ident).alias("id"), micros.alias("t"),
                     F.floor(micros / 1_000_000).alias("sec"), F.floor(micros / 86_400_000_000).alias("day"))
    rows = rows.withColumn("same", move(F.struct("t", "id")).over(W.partitionBy(*keys, "sec").orderBy("t", "id")))
    secs = rows.groupBy(*keys, "day", "sec").agg(nearest(F.struct("t", "id")).alias("edge"))
    near = secs.select(*keys, "day", "sec", move("edge").over(W.partitionBy(*keys, "day").orderBy("sec")).alias("near"))
    days = secs.groupBy(*keys, "day").agg(nearest("edge").alias("edge"))
    far = days.select(*keys, "day", move("edge").over(W.partitionBy(*keys).orderBy("day")).alias("far"))
    return (rows.join(near, [*keys, "day", "sec"]).join(far, [*keys, "day"])
            .select(*keys, "id", "t", F.coalesce("same", "near", "far").alias("other")))


def window_pairs(df: DataFrame, *, keys: list[str], ts: str = "created_at", ident: str = "uuid",
                 hours: float = 24) -> DataFrame:
    """Rows with an earlier row of the same key less than ``hours`` before: the latest such row."""
    gap = F.col("t") - F.col("other.t")
    return neighbor(df, keys=keys, ts=ts, ident=ident).filter(gap < int(hours * 3_600_000_000)).select(
        *keys, F.col("id").alias(ident), F.col("other.id").alias("previous_uuid"), (gap / 1_000_000).alias("gap_seconds"))


def metadata_struct(episodes: DataFrame, column: str = "metadata") -> DataFrame:
    """``meta`` struct next to the rows; malformed documents become null and are dropped.

    The document is bound by a lambda and exploded: a filter would be moved down and parse it, and whatever made it, again.
    """
    parsed = F.from_json(column, f"{schema.METADATA}, _corrupt_record string")
    sound = F.filter(F.array(parsed), lambda m: m.isNotNull() & m["_corrupt_record"].isNull())
    rows = episodes.select(*[c for c in episodes.columns if c != "meta"], F.explode(sound).alias("meta"))
    return rows.withColumn("meta", F.col("meta").dropFields("_corrupt_record"))
