"""Search strategies over one memory graph for a table of queries.

Queries have ``query_id, text, embedding, user_id``; results ``query_id, kind, uuid, score, rank``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest import schema
from palimpsest.functions.scoring import as_score
from palimpsest.functions.text import entity_doc_text, episode_doc_text
from palimpsest.operators import bm25, filters, fusion
from palimpsest.operators.aggregates import top_per_group
from palimpsest.operators.keyword_store import KeywordStore
from palimpsest.operators.traversal import traversal_search
from palimpsest.operators.vectors import similarity_topk

RESULT = ("query_id", "kind", "uuid", "score", "rank")
STRATEGIES = ("semantic", "bm25", "traversal", "hybrid")


@dataclass
class Graph:
    episodes: DataFrame
    entities: DataFrame
    edges: DataFrame
    mentions: DataFrame
    #: Kept keyword indexes by kind (as of ``keyword_stores``); kinds without one are indexed for the search.
    keywords: dict[str, KeywordStore] = field(default_factory=dict)
    #: Facts with their vectors (and all else that a search by vector needs), where these are kept apart from the facts.
    fact_vectors: DataFrame | None = None


@dataclass(frozen=True)
class SearchConfig:
    # The defaults of a search request.
    limit: int = 10
    threshold: float = 0.5
    max_depth: int = 2
    max_seeds: int = 5
    min_bm25_score: float = 0.01
    rrf_k: int = 60
    min_rrf_score: float = 0.001
    tag_match_mode: str = "any"
    decay_factor: float = 0.95
    boost_factor: float = 1.2
    recent_days: int = 7
    apply_decay: bool = True
    apply_boost: bool = False
    include_expired: bool = False
    enable_embeddings: bool = True
    reference_time: str | None = None
    tags: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    episode_filters: dict = field(default_factory=dict)


def _kind(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("kind", F.lit(kind)).select(*RESULT)


def allowed_episodes(g: Graph, cfg: SearchConfig) -> DataFrame:
    return filters.by_kind(filters.by_tags(g.episodes, cfg.tags, cfg.tag_match_mode), cfg.kinds)


def live_edges(edges: DataFrame, cfg: SearchConfig) -> DataFrame:
    return edges if cfg.include_expired else filters.active_edges(edges, cfg.reference_time)


def edges_with_owner(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``user_id`` of an edge: that of its endpoints when both agree, else null (no user's).

    Edges stored with their owner pass unchanged, so that a query needs no join to scope facts.
    """
    if "user_id" in edges.columns:
        return edges

    def owner(side: str) -> DataFrame:
        return entities.select(F.col("uuid").alias(f"{side}_uuid"), F.col("user_id").alias(f"{side}_user"))

    both = edges.join(owner("source"), "source_uuid").join(owner("target"), "target_uuid")
    return both.withColumn("user_id", F.when(F.col("source_user") == F.col("target_user"), F.col("source_user")))


# ---- semantic -----------------------------------------------------------------------------------

def semantic_entities(g: Graph, queries: DataFrame, cfg: SearchConfig, limit: int | None = None) -> DataFrame:
    return _kind(similarity_topk(g.entities, queries, vector="name_embedding", threshold=cfg.threshold,
                                 limit=limit or cfg.limit), "entity")


def semantic_episodes(g: Graph, queries: DataFrame, cfg: SearchConfig, after=None) -> DataFrame:
    corpus = allowed_episodes(g, cfg)
    if after is not None:
        corpus = filters.after(corpus, after)
    return _kind(similarity_topk(corpus, queries, vector="content_embedding", threshold=cfg.threshold,
                                 limit=cfg.limit), "episode")


def semantic_edges(g: Graph, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    apart = getattr(g, "fact_vectors", None)
    live = live_edges(g.edges if apart is None else apart, cfg).filter(F.size("fact_embedding") > 0)
    owned = edges_with_owner(live, g.entities)
    return _kind(similarity_topk(owned, queries, vector="fact_embedding", threshold=cfg.threshold,
                                 limit=cfg.limit), "edge")


def of_query_user(hits: DataFrame, queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows ``query_id, uuid`` whose entity exists and is the query's user's, if the query has one."""
    user = queries.select("query_id", F.nullif(F.col("user_id"), F.lit("")).alias("_wants")).distinct()
    owner = entities.select("uuid", F.col("user_id").alias("_owner"))
    rows = hits.join(owner, "uuid").join(user, "query_id").filter(F.col("_wants").isNull() | (F.col("_wants") == F.col("_owner")))
    return rows.select(*hits.columns)


def semantic_search(g: Graph, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Similar episodes, entities and edges; entities named by a hit episode join at 0.9 of the threshold.

    A query with a user gets that user's entities only, by whatever way they are found.
    """
    eps, direct = semantic_episodes(g, queries, cfg), semantic_entities(g, queries, cfg)
    edges = semantic_edges(g, queries, cfg)
    via = (g.mentions.select(F.col("episode_uuid").alias("uuid"), "entity_uuid")
           .join(eps.select("query_id", "uuid"), "uuid")
           .select("query_id", F.col("entity_uuid").alias("uuid")).distinct()
           .transform(lambda hits: of_query_user(hits, queries, g.entities))
           .withColumn("score", as_score(F.lit(0.9 * cfg.threshold))))
    # A direct hit scores at least the threshold, so the larger score is the direct one.
    ents = direct.select("query_id", "uuid", "score").unionByName(via.select("query_id", "uuid", "score"))
    ents = ents.groupBy("query_id", "uuid").agg(F.max("score").alias("score"))
    times = g.entities.select("uuid", "created_at")
    ents = top_per_group(ents.join(times, "uuid"), ["query_id"],
                         [F.desc("score"), F.desc_nulls_last("created_at"), "uuid"], None)
    return eps.unionByName(_kind(ents, "entity")).unionByName(edges)


# ---- keyword ------------------------------------------------------------------------------------

def keyword_documents(g: Graph, kind: str) -> DataFrame:
    """What the keyword index of a kind holds: episodes with their saved memories, entities, or facts with their owner and expiry."""
    if kind == "episode":
        # Only rows that carry runs need their metadata parsed; the rest keep a null.
        sessions = F.when(F.contains("metadata", F.lit("llm_saved_memory")),
                          F.from_json("metadata", schema.METADATA)["sessions"])
        return bm25.documents(g.episodes, episode_doc_text(F.col("content"), sessions))
    if kind == "entity":
        return bm25.documents(g.entities, entity_doc_text(F.col("name"), F.col("summary")))
    return bm25.documents(edges_with_owner(g.edges, g.entities), F.col("fact"), "expired_at")


def keyword_stores(g: Graph, root: str, kinds: tuple[str, ...] = ("episode", "entity", "edge")) -> dict[str, KeywordStore]:
    """Keyword indexes of the graph's tables, written below ``root`` for this and later sessions."""
    spark = g.episodes.sparkSession
    return {kind: KeywordStore.create(spark, f"{root}/{kind}", carried={"expired_at": "timestamp"} if kind == "edge" else None).add(keyword_documents(g, kind))
            for kind in kinds}


def load_keyword_stores(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("episode", "entity", "edge")) -> dict[str, KeywordStore]:
    return {kind: KeywordStore.load(spark, f"{root}/{kind}") for kind in kinds}


def _kept_index(g: Graph, kind: str) -> KeywordStore | None:
    return getattr(g, "keywords", {}).get(kind)


def bm25_episodes(g: Graph, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    allowed = allowed_episodes(g, cfg).select("uuid") if cfg.tags or cfg.kinds else None
    if store := _kept_index(g, "episode"):
        return _kind(store.search(queries, candidates=allowed, min_score=cfg.min_bm25_score, limit=cfg.limit), "episode")
    index = bm25.build(keyword_documents(g, "episode"))
    subset = None if allowed is None else index.docs.join(allowed, "uuid", "left_semi")
    return _kind(bm25.search(index, queries, candidates=subset, min_score=cfg.min_bm25_score, limit=cfg.limit), "episode")


def bm25_entities(g: Graph, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    if store := _kept_index(g, "entity"):
        return _kind(store.search(queries, min_score=cfg.min_bm25_score, limit=cfg.limit), "entity")
    index = bm25.build(keyword_documents(g, "entity"))
    return _kind(bm25.search(index, queries, min_score=cfg.min_bm25_score, limit=cfg.limit), "entity")


def bm25_edges(g: Graph, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Statistics over all facts; scored are the live ones, a user's when both endpoints are theirs."""
    def live(rows: DataFrame) -> DataFrame:
        return rows if cfg.include_expired else filters.active_edges(rows, cfg.reference_time)

    if store := _kept_index(g, "edge"):
        return _kind(store.search(queries, where=live, min_score=cfg.min_bm25_score, limit=cfg.limit), "edge")
    index = bm25.build(keyword_documents(g, "edge"))
    return _kind(bm25.search(index, queries, candidates=live(index.docs), min_score=cfg.min_bm25_score, limit=cfg.limit), "edge")


def bm25_search(g: Graph, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    """All kinds: from kept indexes if there are any, else by one pass over the documents of all kinds together."""
    if getattr(g, "keywords", {}) or not bm25.is_short(queries):
        return (bm25_episodes(g, queries, cfg).unionByName(bm25_entities(g, queries, cfg))
                .unionByName(bm25_edges(g, queries, cfg)))
    docs = None
    for kind in ("episode", "entity", "edge"):
        own = keyword_documents(g, kind).withColumn("kind", F.lit(kind))
        docs = own if docs is None else docs.unionByName(own, allowMissingColumns=True)

    def scored(docs: DataFrame) -> DataFrame:
        episodes, rest = docs.filter("kind = 'episode'"), docs.filter("kind = 'entity'")
        if cfg.tags or cfg.kinds:
            episodes = episodes.join(allowed_episodes(g, cfg).select("uuid"), "uuid", "left_semi")
        edges = docs.filter("kind = 'edge'")
        live = edges if cfg.include_expired else filters.active_edges(edges, cfg.reference_time)
        return episodes.unionByName(rest).unionByName(live)

    return bm25.search_parts(docs, "kind", queries, candidates=scored, min_score=cfg.min_bm25_score, limit=cfg.limit).select(*RESULT)


def tag_only_search(g: Graph, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Queries without text: the newest episodes that pass the filters, all with score 0.

    The newest ``limit`` are found once for everybody and once per user, so each query meets at
    most ``limit`` rows.
    """
    eps = allowed_episodes(g, cfg).select("uuid", F.coalesce("user_id", F.lit("")).alias("user_id"), "created_at")
    order = [F.desc_nulls_last("created_at"), "uuid"]
    all_users = eps.filter(F.col("user_id") != "").unionByName(eps.withColumn("user_id", F.lit("")))
    newest = top_per_group(all_users, ["user_id"], order, cfg.limit)
    q = queries.filter(F.coalesce(F.trim("text"), F.lit("")) == "").select(
        "query_id", F.coalesce("user_id", F.lit("")).alias("user_id"))
    return _kind(q.join(newest, "user_id").withColumn("score", F.lit(0.0)), "episode")


# ---- graph and hybrid ---------------------------------------------------------------------------

def graph_search(g: Graph, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    seeds = semantic_entities(g, queries, cfg, limit=min(cfg.limit, cfg.max_seeds))
    return traversal_search(g.edges, seeds, max_depth=cfg.max_depth, limit=cfg.limit,
                            include_expired=cfg.include_expired, reference_time=cfg.reference_time,
                            allowed=lambda hits: of_query_user(hits, queries, g.entities)).select(*RESULT)


def hybrid_search(g: Graph, queries: DataFrame, cfg: SearchConfig) -> DataFrame:
    lists = [semantic_search(g, queries, cfg), bm25_search(g, queries, cfg), graph_search(g, queries, cfg)]
    return fusion.rrf_fuse(lists, k=cfg.rrf_k, min_score=cfg.min_rrf_score, limit=cfg.limit).select(*RESULT)


def search(g: Graph, queries: DataFrame, cfg: SearchConfig, strategy: str = "hybrid") -> DataFrame:
    """Answer ``queries`` by ``strategy``.

    Without embeddings semantic and hybrid become keyword search; queries without text are answered
    by filters and recency; decay and boost follow if asked for.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown search strategy {strategy!r}")
    if strategy in ("semantic", "hybrid") and not cfg.enable_embeddings:
        strategy = "bm25"
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    worded, wordless = queries.filter(~blank), queries.filter(blank)
    run = {"semantic": semantic_search, "bm25": bm25_search, "traversal": graph_search, "hybrid": hybrid_search}[strategy]
    out = run(g, worded, cfg)
    if cfg.tags and strategy != "traversal":
        out = out.unionByName(tag_only_search(g, wordless, cfg))
    if cfg.apply_decay or cfg.apply_boost:
        times = fusion.node_times(episodes=g.episodes, entities=g.entities, edges=g.edges)
        out = fusion.rerank_decay_boost(
            out, times, reference_time=cfg.reference_time, decay=cfg.decay_factor if cfg.apply_decay else None,
            boost=cfg.boost_factor if cfg.apply_boost else None, recent_days=cfg.recent_days).select(*RESULT)
    return out


def facts_current(edges: DataFrame, reference_time) -> DataFrame:
    return filters.active_edges(edges, reference_time)


def entity_by_name(g: Graph, names: DataFrame, cfg: SearchConfig) -> DataFrame:
    """The nearest entity to each name's vector."""
    return semantic_entities(g, names, cfg, limit=1)


def entity_context(g: Graph, seeds: DataFrame, cfg: SearchConfig, depth: int = 1) -> DataFrame:
    """Each entity with its relationships up to ``depth`` hops and their number, one row per edge."""
    from palimpsest.operators.traversal import expand

    start = seeds.select(F.col("uuid").alias("query_id"), "uuid").withColumn("score", F.lit(1.0))
    _, used = expand(g.edges, start, max_depth=depth, include_expired=cfg.include_expired,
                     reference_time=cfg.reference_time)
    facts = g.edges.select(F.col("uuid").alias("edge_uuid"), "source_uuid", "target_uuid", "name", "fact", "valid_at")
    named = g.entities.select(F.col("uuid").alias("entity_uuid"), F.col("name").alias("entity_name"), "entity_type")
    counts = used.groupBy("query_id").agg(F.count("*").alias("relationship_count"))
    return (used.join(counts, "query_id").join(facts, "edge_uuid").withColumnRenamed("query_id", "entity_uuid")
            .join(named, "entity_uuid"))


def without(cfg: SearchConfig, **changes) -> SearchConfig:
    return replace(cfg, **changes)
