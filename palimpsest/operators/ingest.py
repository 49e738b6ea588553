"""Extraction, embedding and resolution of entities and facts.

Model calls are plug-in functions that run on batches inside tasks; the defaults need no model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from palimpsest.functions.text import clean_embed_text, content_key, normalize_entity_name, normalize_type, tokenize
from palimpsest.operators.aggregates import top_per_group
from palimpsest.operators.filters import active_edges
from palimpsest.operators.joins import neighbor
from palimpsest.operators.sets import dedup_names
from palimpsest.operators.skew import broadcast_if_small, split_hot_join
from palimpsest.operators.vectors import nearest_in_block, similarity_topk
from palimpsest.session import stage

MARKS = ".,;:!?()[]{}\"'"  # marks that may stand around a word
MATCH_ENTITY, MATCH_FACT = 0.65, 0.8  # fixed values: default thresholds


# ---- plug-in models -----------------------------------------------------------------------------

def map_model(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Run a model over batches; ``make`` builds it once per task (clients, weights)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield model(batch)
    return df.mapInPandas(run, schema)


def hash_embedding(texts: pd.Series, dim: int) -> list[list[float]]:
    """Feature hashing: each token adds one to the bucket its MD5 names; scaled to length one."""
    bucket: dict[str, int] = {}
    out = []
    for text in texts:
        v = np.zeros(dim)
        for tok in text.lower().split():
            if tok not in bucket:
                bucket[tok] = int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim
            v[bucket[tok]] += 1
        norm = np.linalg.norm(v)
        out.append((v / norm if norm else v).tolist())
    return out


def embed_texts(df: DataFrame, column: str, *, output: str = "embedding", dim: int = 64, model: str = "hash",
                embed: Callable[[pd.Series, int], list] = hash_embedding) -> DataFrame:
    """Embed each distinct text once, then give it to all rows that carry it."""
    keyed = df.withColumn("_k", content_key(F.lit(model), F.lit(str(dim)), clean_embed_text(F.col(column))))
    distinct = keyed.select("_k", clean_embed_text(F.col(column)).alias("t")).groupBy("_k").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_k": b["_k"], output: embed(b["t"], dim)})

    vectors = distinct.mapInPandas(run, f"_k string, {output} array<double>")
    return split_hot_join(keyed, vectors, ["_k"]).drop("_k")


# ---- extraction ---------------------------------------------------------------------------------

def extract_entities(episodes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Default extractor: names of ``dictionary(name, entity_type)`` found in the text, once per document.

    ``episode_uuid, user_id, name, entity_type, position`` with normalised names. A name may have several words;
    marks around a word do not count, in the text or in the dictionary.
    """
    def bare(c: Column) -> Column:
        return F.transform(tokenize(c), lambda w: F.btrim(w, F.lit(MARKS)))

    words = dictionary.select(F.array_join(bare(F.col("name")), " ").alias("tok"), F.size(bare(F.col("name"))).alias("n"),
                              normalize_type(F.col("entity_type")).alias("entity_type")).filter("tok <> ''")
    sizes = sorted(r.n for r in words.select("n").distinct().collect())  # numbers of words, a few
    words = broadcast_if_small(words.groupBy("tok").agg(F.min("entity_type").alias("entity_type")))

    def runs(ws: Column) -> Column:
        """Every run of as many words as some name has, with its position."""
        def of(n: int) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - n, F.lit(0)))
            return F.when(F.size(ws) >= n, F.transform(starts, lambda i: F.struct(
                i.alias("position"), F.array_join(F.slice(ws, i + 1, F.lit(n)), " ").alias("tok"))))

        each = [of(n) for n in sizes]
        none = F.array().cast("array<struct<position:int,tok:string>>")
        return F.concat(none, *[F.coalesce(e, none) for e in each])

    # a lambda over one element binds the words, so that they are made once per row
    toks = episodes.select(F.col("uuid").alias("episode_uuid"), "user_id",
                           F.explode(F.flatten(F.transform(F.array(bare(F.col("content"))), runs))).alias("r"))
    found = toks.select("episode_uuid", "user_id", "r.*").join(words, "tok").withColumnRenamed("tok", "name")
    return dedup_names(found, document="episode_uuid", name="name", position="position").select(
        "episode_uuid", "user_id", F.col("normalized").alias("name"), "entity_type", "position")


def extract_relations(mentioned: DataFrame, relation: str = "RELATED_TO") -> DataFrame:
    """Default extractor: each entity of an episode relates to the next one named (a chain, so the
    number of facts is linear in the text)."""
    nxt = F.lead("name").over(W.partitionBy("episode_uuid").orderBy("position", "name"))
    rows = mentioned.withColumn("target", nxt).filter("target IS NOT NULL")
    return rows.select("episode_uuid", "user_id", F.col("name").alias("source"), F.lit(relation).alias("relation"), "target",
                       F.concat("name", F.lit(" is mentioned with "), "target").alias("fact"))


# ---- resolution ---------------------------------------------------------------------------------

def resolve_entities(found: DataFrame, existing: DataFrame, *, threshold: float = MATCH_ENTITY) -> DataFrame:
    """Match ``user_id, name, entity_type, embedding`` to the nearest stored entity of the user, else
    make a new one; equal names of a batch share the result.

    ``user_id, name, entity_type, uuid, canonical_name, is_new, mentions``.
    """
    norm = normalize_entity_name(F.col("name"))
    batch = found.withColumn("name", norm).groupBy("user_id", "name").agg(
        F.min("entity_type").alias("entity_type"), F.count("*").alias("mentions"),
        F.min_by("embedding", "entity_type").alias("embedding"))
    batch = batch.withColumn("query_id", content_key(F.coalesce("user_id", F.lit("")), F.col("name")))
    # a row without a user is its own tenant: it meets stored rows without a user only
    owned, free = F.col("user_id").isNotNull(), F.col("user_id").isNull()
    hit = similarity_topk(existing, batch.filter(owned), vector="name_embedding", threshold=threshold, limit=1).unionByName(
        similarity_topk(existing.filter(free), batch.filter(free), vector="name_embedding", threshold=threshold, limit=1))
    named = hit.join(existing.select("uuid", F.col("name").alias("stored_name")), "uuid").select("query_id", "uuid", "stored_name")
    return batch.join(named, "query_id", "left").select(
        "user_id", "name", "entity_type", F.coalesce("uuid", "query_id").alias("uuid"),
        F.coalesce("stored_name", "name").alias("canonical_name"), F.col("uuid").isNull().alias("is_new"), "mentions")


def resolve_relations(found: DataFrame, entities: DataFrame, edges: DataFrame, *, threshold: float = MATCH_FACT,
                      reference_time=None, vectors: DataFrame | None = None) -> DataFrame:
    """Map endpoint names to ids (facts with an unknown endpoint are dropped) and reuse the nearest
    active fact between the same endpoints.

    found: ``user_id, source, target, relation, fact, embedding``; entities: ``user_id, name, uuid``.
    With ``vectors(vec_id, vec)`` both kinds of facts carry ``vec_id`` in place of their vector, and only facts whose
    ends are known, and stored ones between the ends of such, get it.
    """
    ids = entities.groupBy("user_id", "name").agg(F.min("uuid").alias("uuid"))
    def end(side: str) -> DataFrame:
        return ids.select("user_id", F.col("name").alias(side), F.col("uuid").alias(f"{side}_uuid"))

    # One id per name: adaptive execution splits the partition of a name that holds many facts.
    known = found.join(end("target"), ["user_id", "target"]).join(end("source"), ["user_id", "source"])
    if vectors is not None:
        vectors = broadcast_if_small(vectors)
        known = known.join(vectors, "vec_id", "left").withColumnRenamed("vec", "embedding")
    new_id = content_key(F.col("source_uuid"), F.col("relation"), F.col("target_uuid"), F.col("fact"))
    known = known.groupBy("source_uuid", "target_uuid", "relation", "fact").agg(
        F.count("*").alias("mentions"), F.min("embedding").alias("embedding")).withColumn("new_uuid", new_id)
    known, ends = stage(known), ["source_uuid", "target_uuid"]
    stored = active_edges(edges, reference_time)
    if vectors is not None:
        stored = stored.join(known.select(*ends).distinct(), ends, "left_semi").join(vectors, "vec_id").withColumnRenamed("vec", "fact_embedding")
    hit = nearest_in_block(
        known.filter(F.size("embedding") > 0).select(*ends, F.col("new_uuid").alias("id"), F.col("embedding").alias("vec")),
        stored.filter(F.size("fact_embedding") > 0).select(
            *ends, F.col("uuid").alias("id"), F.col("fact_embedding").alias("vec")), ends, threshold=threshold)
    out = known.join(hit.select(F.col("id").alias("new_uuid"), F.col("other").alias("uuid")), "new_uuid", "left")
    return out.select(F.coalesce("uuid", "new_uuid").alias("uuid"), "source_uuid", "target_uuid",
                      F.col("relation").alias("name"), "fact", "mentions", F.col("uuid").isNull().alias("is_new"))


def build_mentions(pairs: DataFrame) -> DataFrame:
    """One link per (episode, entity): ``episode_uuid, entity_uuid, created_at``."""
    one = pairs.groupBy("episode_uuid", "entity_uuid").agg(F.min("created_at").alias("created_at"))
    return one.withColumn("uuid", content_key(F.col("episode_uuid"), F.col("entity_uuid")))


def invalidate_contradictions(edges: DataFrame, single_valued: list[str], reference_time) -> DataFrame:
    """For relations with one value at a time, a later fact of the same source ends the earlier one.

    The fact is no longer valid from the later one's valid time on; it is recorded as expired at ``reference_time``.
    """
    once = edges.filter(F.col("name").isin(single_valued) & F.col("expired_at").isNull())
    later = neighbor(once, keys=["source_uuid", "name"], ts="valid_at", ident="uuid", direction="next")
    ended = later.filter("other IS NOT NULL").select(F.col("id").alias("uuid"), F.timestamp_micros(F.col("other.t")).alias("_end"))
    return edges.join(ended, "uuid", "left").withColumns({
        "invalid_at": F.coalesce("_end", "invalid_at"),
        "expired_at": F.when(F.col("_end").isNotNull(), F.lit(reference_time).cast("timestamp")).otherwise(F.col("expired_at"))}).drop("_end")


def expire_contradicted(edges: DataFrame, judged: DataFrame, reference_time) -> DataFrame:
    """Model-judged case: ``judged(uuid)`` lists the stored facts a new fact contradicts."""
    hit = judged.select("uuid").distinct().withColumn("_hit", F.lit(True))
    return edges.join(hit, "uuid", "left").withColumn("expired_at", F.when(
        F.col("_hit") & F.col("expired_at").isNull(), F.lit(reference_time).cast("timestamp")).otherwise(F.col("expired_at"))).drop("_hit")


def contradiction_candidates(new_edges: DataFrame, edges: DataFrame, reference_time) -> DataFrame:
    """Active facts with the source and relation of a new fact, itself excluded: what a judge must see."""
    n = new_edges.select(F.col("uuid").alias("new_uuid"), F.col("fact").alias("new_fact"), "source_uuid", "name")
    old = active_edges(edges, reference_time).select("uuid", "fact", "source_uuid", "name")
    return n.join(old, ["source_uuid", "name"]).filter("uuid <> new_uuid")


def summary_context(entities: DataFrame, relationships: DataFrame, limit: int = 5) -> DataFrame:
    """Text for a summariser: the newest ``limit`` relationships as ``- TYPE: other``."""
    few = top_per_group(relationships.select("entity_uuid", "relation_type", "other_name", "valid_at", "edge_uuid"),
                        ["entity_uuid"], [F.desc_nulls_last("valid_at"), "edge_uuid"], limit)
    line = F.concat(F.lit("- "), "relation_type", F.lit(": "), "other_name")
    lines = few.groupBy("entity_uuid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("ls"))
    return entities.select(F.col("uuid").alias("entity_uuid"), "name", "summary").join(lines, "entity_uuid").select(
        "entity_uuid", "name", "summary", F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("context"))


def update_summaries(entities: DataFrame, contexts: DataFrame) -> DataFrame:
    """Default summariser: the context becomes the summary."""
    c = contexts.select(F.col("entity_uuid").alias("uuid"), "context")
    return entities.join(c, "uuid", "left").withColumn("summary", F.coalesce("context", "summary")).drop("context")


def link_episode_edges(episodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Write the ids of an episode's facts back to it (the list is part of the data model)."""
    per = edges.select(F.explode("episodes").alias("uuid"), F.col("uuid").alias("edge")).groupBy("uuid").agg(
        F.array_sort(F.collect_set("edge")).alias("_e"))
    base = episodes.drop("entity_edges")
    return base.join(per, "uuid", "left").withColumnRenamed("_e", "entity_edges")
