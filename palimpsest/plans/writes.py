"""Upserts, ingestion, maintenance and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import bm25, community, dedup, ingest, joins, louvain, maintain, upserts
from palimpsest.operators.keyed_store import KeyedStore
from palimpsest.plans.basics import tok
from palimpsest.plans.registry import register
from palimpsest.plans.retrieval import ACTIVE, bm25_ctes, sim_sql, T
from palimpsest.session import stage
from palimpsest.sources.standins import EDGE_REFERENCE_TIME as ERT
from palimpsest.sources.tables import write_snapshot
from palimpsest.streaming.incremental import fresh_path

# ---- upserts ------------------------------------------------------------------------------------


@register("upsert_episodes", """
    SELECT coalesce(e.uuid, u.uuid) AS uuid, coalesce(e.name, u.name) AS name, coalesce(u.kind, e.kind) AS kind, coalesce(e.created_at, u.created_at) AS created_at
    FROM fx_episodes e FULL JOIN u ON u.uuid = e.uuid""", extra="""
    u AS (SELECT CASE WHEN quality = 1 THEN 'd' ELSE 'new' END || doc_id AS uuid, 'Label ' || doc_id AS name, 'query' AS kind, TIMESTAMP '2024-01-31' AS created_at FROM labels)""")
def _(s):
    ups = s.table("labels").select(
        F.concat(F.when(F.col("quality") == 1, "d").otherwise("new"), "doc_id").alias("uuid"), F.concat(F.lit("Label "), "doc_id").alias("name"),
        F.lit("query").alias("kind"), F.lit("2024-01-31").cast("timestamp").alias("created_at"))
    return upserts.upsert_episodes(s.episodes().select("uuid", "name", "kind", "created_at"), ups)


@register("upsert_entities", """
    SELECT coalesce(e.uuid, u.uuid) AS uuid, coalesce(e.name, u.name) AS name, coalesce(u.summary, e.summary) AS summary,
           (coalesce(e.mentions, 0) + coalesce(u.mentions, 0))::BIGINT AS mentions, coalesce(e.created_at, u.created_at) AS created_at
    FROM fx_entities e FULL JOIN u ON u.uuid = e.uuid""", extra="""
    u AS (SELECT uuid, max({'t': created_at, 'n': name}).n AS name, max({'t': created_at, 'n': name, 's': summary}).s AS summary, sum(mentions) AS mentions, max(created_at) AS created_at FROM (
        SELECT entity_uuid AS uuid, episode_uuid AS name, 'seen in ' || episode_uuid AS summary, 1 AS mentions, created_at FROM fx_mentions
        UNION ALL SELECT 'x' || item_id, 'topic', text, 1, TIMESTAMP '2024-01-31' FROM benchmark) GROUP BY 1)""")
def _(s):
    seen = s.mentions().select(F.col("entity_uuid").alias("uuid"), F.col("episode_uuid").alias("name"),
                               F.concat(F.lit("seen in "), "episode_uuid").alias("summary"), F.lit(1).cast("long").alias("mentions"), "created_at")
    new = s.table("benchmark").select(F.concat(F.lit("x"), "item_id").alias("uuid"), F.lit("topic").alias("name"), F.col("text").alias("summary"),
                                      F.lit(1).cast("long").alias("mentions"), F.lit("2024-01-31").cast("timestamp").alias("created_at"))
    target = s.entities().select("uuid", "name", "summary", "mentions", "created_at")
    return upserts.upsert_entities(target, seen.unionByName(new))


@register("upsert_edges", """
    SELECT coalesce(e.uuid, u.uuid) AS uuid, coalesce(u.fact, e.fact) AS fact, (coalesce(e.mentions, 0) + coalesce(u.mentions, 0))::BIGINT AS mentions,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(e.episodes, []), coalesce(u.episodes, [])))), ',') AS episodes, coalesce(e.created_at, u.created_at) AS created_at
    FROM fx_edges e FULL JOIN u ON u.uuid = e.uuid""", extra="""
    u AS (SELECT CASE WHEN l_linenumber = 7 THEN 'x' ELSE 'e' END || l_suppkey || '_' || l_partkey || '_' || l_returnflag AS uuid,
            max({'t': l_shipdate, 'f': 'order ' || l_orderkey}).f AS fact, count(*) AS mentions, list_distinct(list('o' || l_orderkey)) AS episodes, max(l_shipdate) AS created_at
          FROM lineitem GROUP BY 1)""")
def _(s):
    ups = s.table("lineitem").select(
        F.concat(F.when(F.col("l_linenumber") == 7, "x").otherwise("e"), "l_suppkey", F.lit("_"), "l_partkey", F.lit("_"), "l_returnflag").alias("uuid"),
        F.concat(F.lit("order "), "l_orderkey").alias("fact"), F.lit(1).cast("long").alias("mentions"),
        F.array(F.concat(F.lit("o"), "l_orderkey")).alias("episodes"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    target = s.edges().select("uuid", "fact", "mentions", "episodes", "created_at")
    out = upserts.upsert_edges(target, ups)
    return out.withColumn("episodes", F.array_join(F.array_sort("episodes"), ","))


@register("upsert_edges_log", """
    SELECT coalesce(e.uuid, u.uuid) AS uuid, coalesce(u.fact, e.fact) AS fact, (coalesce(e.mentions, 0) + coalesce(u.mentions, 0))::BIGINT AS mentions,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(e.episodes, []), coalesce(u.episodes, [])))), ',') AS episodes, coalesce(e.created_at, u.first) AS created_at
    FROM fx_edges e FULL JOIN u ON u.uuid = e.uuid""", extra="""
    b AS (SELECT 'e' || l_suppkey || '_' || l_partkey || '_' || l_linestatus AS uuid, l_linenumber, max({'t': l_shipdate, 'f': 'order ' || l_orderkey}) AS m,
            count(*) AS mentions, list_distinct(list('o' || l_orderkey)) AS episodes FROM lineitem GROUP BY 1, 2),
    u AS (SELECT uuid, arg_max(m.f, l_linenumber) AS fact, sum(mentions) AS mentions, list_distinct(flatten(list(episodes))) AS episodes, arg_min(m.t, l_linenumber) AS first FROM b GROUP BY 1)""")
def _(s):
    """Every line number is a batch of an upsert log, which is compacted on the way; the table is merged when it is read."""
    lines = s.table("lineitem").select(
        "l_linenumber", F.concat(F.lit("e"), "l_suppkey", F.lit("_"), "l_partkey", F.lit("_"), "l_linestatus").alias("uuid"),
        F.concat(F.lit("order "), "l_orderkey").alias("fact"), F.lit(1).cast("long").alias("mentions"),
        F.array(F.concat(F.lit("o"), "l_orderkey")).alias("episodes"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    lists = F.array_sort(F.array_distinct(F.flatten(F.collect_set("episodes"))))
    rules = {"fact": "new", "mentions": "sum", "episodes": "union"}
    store = KeyedStore.create(s.spark, fresh_path(s.spark, "edge-log"), s.edges().select("uuid", "fact", "mentions", "episodes", "created_at"), ["uuid"], rules, buckets=8)
    for number in range(1, 8):
        batch = store.placed(lines.filter(F.col("l_linenumber") == number).drop("l_linenumber"))
        one = upserts.latest(batch, ["_bucket", "uuid"], tie="fact", mentions=F.sum("mentions"), episodes=lists)
        store = store.apply(one, batch=("lines", number), most_entries=4)
    return store.read().withColumn("episodes", F.array_join(F.array_sort("episodes"), ","))


@register("upsert_mentions", """
    SELECT uuid, episode_uuid, entity_uuid, created_at FROM fx_mentions UNION ALL
    SELECT 'new' || doc_id, 'd' || doc_id, 's0', TIMESTAMP '2024-01-31' FROM labels""")
def _(s):
    old = s.mentions()
    new = s.table("labels").select(F.concat(F.lit("new"), "doc_id").alias("uuid"), F.concat(F.lit("d"), "doc_id").alias("episode_uuid"),
                                   F.lit("s0").alias("entity_uuid"), F.lit("2024-01-31").cast("timestamp").alias("created_at"))
    again = old.withColumn("created_at", F.lit("2024-01-31").cast("timestamp"))
    return upserts.upsert_mentions(old, new.unionByName(again))


def tool_updates(s):
    lines = s.table("lineitem").join(s.table("part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    name = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") == 6, F.concat("p_brand", F.lit(" tool"))).otherwise(F.col("p_name"))
    return lines.select(name.alias("tool_name"), F.concat(F.lit("seen "), "l_orderkey").alias("description"),
                        F.concat(F.lit("tool_"), name).alias("uuid"), F.col("l_orderkey").alias("created_at"))


_TOOLS = """
    raw AS (SELECT CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN p_brand || ' tool' ELSE p_name END AS tool_name, 'seen ' || l_orderkey AS description, l_orderkey AS k
            FROM lineitem JOIN part ON p_partkey = l_partkey),
    u AS (SELECT tool_name, arg_max(description, k) AS description, count(*) AS mentions FROM raw WHERE tool_name IS NOT NULL GROUP BY 1)"""


@register("upsert_tools", """
    SELECT coalesce(t.tool_name, u.tool_name) AS tool_name, coalesce(u.description, t.description) AS description,
           (coalesce(t.mentions, 0) + coalesce(u.mentions, 0))::BIGINT AS mentions FROM fx_tools t FULL JOIN u ON u.tool_name = t.tool_name""", extra=_TOOLS)
def _(s):
    return upserts.upsert_tools(s.tools(), tool_updates(s))[0].drop("uuid")


@register("upsert_tools_counts", """
    SELECT (SELECT count(*) FROM u WHERE tool_name NOT IN (SELECT tool_name FROM fx_tools)) AS saved,
           (SELECT count(*) FROM u WHERE tool_name IN (SELECT tool_name FROM fx_tools)) AS updated,
           (SELECT count(*) FROM raw WHERE tool_name IS NULL) AS failed""", extra=_TOOLS)
def _(s):
    return upserts.upsert_tools(s.tools(), tool_updates(s))[1]


@register("upsert_instructions", """
    SELECT coalesce(t.agent_type, u.agent_type) AS agent_type, coalesce(t.base_instruction, u.base_instruction) AS base_instruction,
           coalesce(u.enhanced_instruction, t.enhanced_instruction) AS enhanced_instruction, coalesce(u.updated_at, t.updated_at) AS updated_at
    FROM (SELECT agent_type, base_instruction, arg_max(enhanced_instruction, uuid) AS enhanced_instruction, arg_max(updated_at, uuid) AS updated_at FROM fx_instructions GROUP BY 1, 2) t
    FULL JOIN (SELECT c_mktsegment AS agent_type, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent ' ELSE 'serve nation ' END || c_nationkey AS base_instruction,
                      max({'d': o_orderdate, 'u': 'o' || o_orderkey}).u AS enhanced_instruction, max(o_orderdate) AS updated_at
               FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) u USING (agent_type, base_instruction)""")
def _(s):
    target = s.instructions().groupBy("agent_type", "base_instruction").agg(
        F.max_by("enhanced_instruction", "uuid").alias("enhanced_instruction"), F.max_by("updated_at", "uuid").alias("updated_at"))
    ups = s.table("orders").join(s.table("customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select(
        F.col("c_mktsegment").alias("agent_type"),
        F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "urgent ").otherwise("serve nation "), "c_nationkey").alias("base_instruction"),
        F.concat(F.lit("o"), "o_orderkey").alias("enhanced_instruction"), F.concat(F.lit("o"), "o_orderkey").alias("uuid"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return upserts.upsert_instructions(target, ups)


# ---- de-duplication -----------------------------------------------------------------------------

def _fold_sql(rows: str, hours: int = 24) -> str:
    """Recursive CTEs: the row-by-row rule over ``rows(g, id, t)``."""
    return f"""
    o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY t, id) AS rn FROM ({rows})),
    f AS (SELECT g, id, t, rn, t AS at, id AS aid FROM o WHERE rn = 1 UNION ALL
          SELECT o.g, o.id, o.t, o.rn, CASE WHEN o.t - f.at >= INTERVAL {hours} HOUR THEN o.t ELSE f.at END,
                 CASE WHEN o.t - f.at >= INTERVAL {hours} HOUR THEN o.id ELSE f.aid END FROM f JOIN o ON o.g = f.g AND o.rn = f.rn + 1)"""


DEDUP_OUT = "SELECT id AS input_id, aid AS canonical_uuid, id = aid AS is_new FROM f"
EXACT = _fold_sql("SELECT user_id || '|' || sha256(content) AS g, uuid AS id, created_at AS t FROM fx_episodes")


@register("dedup_exact", DEDUP_OUT, extra=EXACT, recursive=True)
def _(s):
    return dedup.dedup_exact(s.episodes())


@register("dedup_exact_events", DEDUP_OUT, recursive=True,
          extra=_fold_sql("SELECT user_key || '|' || tool_name AS g, event_id AS id, ts AS t FROM fx_tool_calls"))
def _(s):
    return dedup.dedup_within(s.tool_calls(), keys=["user_key", "tool_name"], ts="ts", ident="event_id")


@register("dedup_exact_existing", """
    SELECT e.uuid AS input_id, coalesce(x.uuid, f.aid) AS canonical_uuid, coalesce(x.uuid, f.aid) = e.uuid AS is_new
    FROM fx_episodes e LEFT JOIN f ON f.id = e.uuid LEFT JOIN cov x ON x.id = e.uuid""", recursive=True, extra="""
    ex AS (SELECT 'stored_' || uuid AS uuid, user_id, sha256(content) AS ck, created_at - INTERVAL 23 HOUR AS created_at FROM fx_episodes WHERE kind = 'query'),
    cov AS (SELECT e.uuid AS id, arg_max(ex.uuid, (ex.created_at, ex.uuid)) AS uuid FROM fx_episodes e JOIN ex ON ex.user_id = e.user_id AND ex.ck = sha256(e.content)
            AND ex.created_at <= e.created_at AND e.created_at - ex.created_at < INTERVAL 24 HOUR GROUP BY 1),""" + _fold_sql(
    "SELECT user_id || '|' || sha256(content) AS g, uuid AS id, created_at AS t FROM fx_episodes WHERE uuid NOT IN (SELECT id FROM cov)"))
def _(s):
    eps = s.episodes()
    stored = eps.filter("kind = 'query'").select(F.concat(F.lit("stored_"), "uuid").alias("uuid"), "user_id", "content",
                                                 (F.col("created_at") - F.expr("INTERVAL 23 HOURS")).alias("created_at"))
    return dedup.dedup_exact(eps, existing=stored)


DT = 0.25
SEMANTIC_DEDUP = f"""
    v AS (SELECT uuid AS id, user_id, created_at AS t, content_embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY user_id ORDER BY created_at, uuid) AS rn
          FROM fx_doc_episodes WHERE content_embedding IS NOT NULL),
    p AS (SELECT a.id, b.id AS kid, b.t AS kt, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.user_id = b.user_id AND b.rn < a.rn
          AND a.t - b.t < INTERVAL 24 HOUR WHERE round(list_cosine_similarity(a.e, b.e), 6) >= {DT}),
    nb AS (SELECT v.id, v.user_id, v.rn, coalesce(list(kid) FILTER (kid IS NOT NULL), []) AS ns FROM v LEFT JOIN p ON p.id = v.id GROUP BY ALL),
    k AS (SELECT user_id, rn, id, true AS keep, [id] AS kept FROM nb WHERE rn = 1 UNION ALL
          SELECT nb.user_id, nb.rn, nb.id, NOT list_has_any(nb.ns, k.kept), CASE WHEN list_has_any(nb.ns, k.kept) THEN k.kept ELSE list_append(k.kept, nb.id) END
          FROM k JOIN nb ON nb.user_id = k.user_id AND nb.rn = k.rn + 1),
    r AS (SELECT k.id, CASE WHEN k.keep THEN k.id ELSE b.kid END AS kid, CASE WHEN k.keep THEN 1.0 ELSE b.score END AS score FROM k LEFT JOIN (
          SELECT p.id, p.kid, p.score, row_number() OVER (PARTITION BY p.id ORDER BY p.score DESC, p.kt DESC, p.kid) AS n
          FROM p JOIN k kk ON kk.id = p.kid AND kk.keep) b ON b.id = k.id AND b.n = 1)"""
SEM_OUT = """SELECT uuid AS input_id, coalesce(r.kid, uuid) AS canonical_uuid, coalesce(r.kid, uuid) = uuid AS is_new, coalesce(r.score, 1.0)::DOUBLE AS score
             FROM fx_doc_episodes LEFT JOIN r ON r.id = uuid"""


@register("dedup_semantic", SEM_OUT, extra=SEMANTIC_DEDUP, recursive=True)
def _(s):
    return dedup.dedup_semantic(s.doc_episodes(), threshold=DT)


def _thinning(pairs: str, rows: str) -> str:
    """``rows(id, user_id, rn)`` kept in order: a row goes if an earlier kept one is among its ``pairs(id, kid)``."""
    return f"""
    nb AS (SELECT v.id, v.user_id, v.rn, coalesce(list(kid) FILTER (kid IS NOT NULL), []) AS ns FROM {rows} v LEFT JOIN {pairs} p ON p.id = v.id GROUP BY ALL),
    k AS (SELECT user_id, rn, id, true AS keep, [id] AS kept FROM nb WHERE rn = 1 UNION ALL
          SELECT nb.user_id, nb.rn, nb.id, NOT list_has_any(nb.ns, k.kept), CASE WHEN list_has_any(nb.ns, k.kept) THEN k.kept ELSE list_append(k.kept, nb.id) END
          FROM k JOIN nb ON nb.user_id = k.user_id AND nb.rn = k.rn + 1)"""


_COS = "round(list_cosine_similarity(a.e, b.e), 6)"


@register("dedup_semantic_existing", """
    SELECT uuid AS input_id, coalesce(r.kid, uuid) AS canonical_uuid, coalesce(r.kid, uuid) = uuid AS is_new, coalesce(r.score, 1.0)::DOUBLE AS score
    FROM fx_episodes LEFT JOIN r ON r.id = uuid""", recursive=True, extra=f"""
    ev AS (SELECT uuid AS id, user_id, created_at AS t, content_embedding::DOUBLE[] AS e FROM fx_doc_episodes WHERE content_embedding IS NOT NULL),
    old AS (SELECT 'stored_' || id AS id, user_id, t - INTERVAL 23 HOUR AS t, e FROM ev JOIN labels ON id = 'd' || doc_id WHERE quality = 1),
    co AS (SELECT a.id, b.id AS kid, b.t AS kt, {_COS} AS score FROM ev a JOIN old b ON a.user_id = b.user_id AND b.t <= a.t AND a.t - b.t < INTERVAL 24 HOUR WHERE {_COS} >= {DT}),
    v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, id) AS rn FROM ev WHERE id NOT IN (SELECT id FROM co)),
    p AS (SELECT a.id, b.id AS kid FROM v a JOIN v b ON a.user_id = b.user_id AND b.rn < a.rn AND a.t - b.t < INTERVAL 24 HOUR WHERE {_COS} >= {DT}),
    {_thinning('p', 'v')},
    h AS (SELECT * FROM co UNION ALL SELECT a.id, b.id, b.t, {_COS} FROM ev a JOIN ev b ON a.user_id = b.user_id AND (b.t, b.id) < (a.t, a.id)
          AND a.t - b.t < INTERVAL 24 HOUR JOIN k ON k.id = b.id AND k.keep WHERE {_COS} >= {DT} AND a.id NOT IN (SELECT id FROM k WHERE keep)),
    r AS (SELECT id, kid, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, kt DESC, kid) AS n FROM h) WHERE n = 1)""")
def _(s):
    """Every episode, against stored ones 23 hours older: those of good quality."""
    good = s.table("labels").filter("quality = 1").select(F.concat(F.lit("d"), "doc_id").alias("uuid"))
    stored = s.doc_episodes().join(good, "uuid", "left_semi").select(
        F.concat(F.lit("stored_"), "uuid").alias("uuid"), "user_id", "content_embedding", (F.col("created_at") - F.expr("INTERVAL 23 HOURS")).alias("created_at"))
    return dedup.dedup_semantic(s.episodes(), threshold=DT, existing=stored)


BT = 40.0  # whole documents share many words; short questions would take the default
BATCH = ("SELECT uuid, user_id, created_at, content AS txt FROM fx_episodes UNION ALL "
         "SELECT 'b' || item_id, 'u_en', TIMESTAMP '2024-01-01 00:00:00', text FROM benchmark")


@register("dedup_bm25_batch", """
    SELECT uuid AS input_id, coalesce(r.kid, uuid) AS canonical_uuid, r.kid IS NULL AS is_new FROM fx_episodes LEFT JOIN r ON r.id = uuid""", recursive=True, extra=f"""
    fx_bq AS (SELECT uuid AS query_id, user_id, content AS text, created_at AS qt FROM fx_episodes),""" + bm25_ctes("k", BATCH).replace("fx_queries", "fx_bq").rsplit(",\n    k AS (", 1)[0] + f""",
    m AS (SELECT h.query_id AS id, h.uuid AS kid, h.created_at AS kt, h.uuid NOT IN (SELECT query_id FROM fx_bq) AS stored FROM k_hit h JOIN fx_bq q USING (query_id)
          WHERE h.score >= {BT} AND ((h.created_at, h.uuid) < (q.qt, q.query_id)) AND q.qt - h.created_at < INTERVAL 24 HOUR
          UNION SELECT a.query_id, b.query_id, b.qt, false FROM fx_bq a JOIN fx_bq b ON a.text = b.text AND a.user_id = b.user_id AND (b.qt, b.query_id) < (a.qt, a.query_id)
          AND a.qt - b.qt < INTERVAL 24 HOUR),
    v AS (SELECT query_id AS id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY qt, query_id) AS rn FROM fx_bq WHERE query_id NOT IN (SELECT id FROM m WHERE stored)),
    {_thinning('(SELECT id, kid FROM m WHERE NOT stored)', 'v').replace(' k AS', ' kk AS').replace('k.', 'kk.').replace('FROM k ', 'FROM kk ')},
    r AS (SELECT id, kid FROM (SELECT m.*, row_number() OVER (PARTITION BY m.id ORDER BY kt DESC, kid) AS n FROM m
          WHERE stored OR kid IN (SELECT id FROM kk WHERE keep)) WHERE n = 1)""")
def _(s):
    """Every episode as one batch after the benchmark texts, which are stored."""
    stored = s.table("benchmark").select(F.concat(F.lit("b"), "item_id").alias("uuid"), F.lit("u_en").alias("user_id"),
                                         F.lit("2024-01-01").cast("timestamp").alias("created_at"), "text")
    index = bm25.build(bm25.documents(stored, F.col("text")))
    return dedup.dedup_bm25_batch(s.plain_episodes().select("uuid", "user_id", "created_at", "content"), index, threshold=BT)


@register("dedup_bm25", """
    SELECT q.query_id AS input_id, h.uuid AS canonical_uuid, h.uuid IS NULL AS is_new FROM fx_queries q LEFT JOIN (
      SELECT query_id, max({'t': created_at, 's': score, 'u': uuid}).u AS uuid FROM k_hit WHERE score >= 0.7 GROUP BY 1) h USING (query_id)""",
          extra=bm25_ctes("k", "SELECT *, content AS txt FROM fx_episodes", "created_at > TIMESTAMP '2024-01-03' - INTERVAL 24 HOUR"))
def _(s):
    index = bm25.build(bm25.documents(s.episodes(), F.col("content")))
    return dedup.dedup_bm25(s.queries(), index, reference_time="2024-01-03")


@register("resolve_duplicates_report", "SELECT aid AS canonical_uuid, count(*) AS inputs, count(*) FILTER (id <> aid) AS duplicates FROM f GROUP BY 1",
          extra=EXACT, recursive=True)
def _(s):
    return dedup.resolve_duplicates_report(dedup.dedup_exact(s.episodes()))


# ---- extraction and resolution ------------------------------------------------------------------

def dictionary(s):
    """All words of the benchmark, and the first two words of each item as one name."""
    toks = s.table("benchmark").select(text.tokenize(F.col("text")).alias("ts"))
    pairs = toks.filter("size(ts) > 1").select(F.array_join(F.slice("ts", 1, 2), " ").alias("name"))
    words = toks.select(F.explode("ts").alias("name")).unionByName(pairs).distinct()
    return words.withColumn("entity_type", F.lit("long word"))


_BARE = "list_transform({}, lambda w: trim(w, '.,;:!?()[]{{}}\"' || chr(39)))"
FOUND = f"""
    dtoks AS (SELECT {_BARE.format(tok('text'))} AS ts FROM benchmark),
    dict AS (SELECT name, n FROM (SELECT unnest(ts) AS name, 1 AS n FROM dtoks UNION SELECT array_to_string(ts[1:2], ' '), 2 FROM dtoks WHERE len(ts) > 1) WHERE name <> ''),
    etoks AS (SELECT uuid, user_id, {_BARE.format(tok('content'))} AS ts FROM fx_episodes),
    toks AS (SELECT uuid, user_id, unnest(ts) AS name, unnest(range(len(ts))) AS position FROM etoks UNION ALL
             SELECT uuid, user_id, array_to_string(ts[i + 1:i + 2], ' '), i FROM (SELECT uuid, user_id, ts, unnest(range(len(ts) - 1)) AS i FROM etoks WHERE len(ts) > 1)),
    found AS (SELECT uuid AS episode_uuid, user_id, replace(name, ' ', '_') AS name, min(position)::INTEGER AS position FROM toks WHERE name IN (SELECT name FROM dict) GROUP BY ALL)"""
CHAIN = FOUND + """,
    chain AS (SELECT episode_uuid, user_id, name AS source, lead(name) OVER (PARTITION BY episode_uuid ORDER BY position, name) AS target FROM found)"""


@register("extract_entities", "SELECT episode_uuid, user_id, name, 'LONG_WORD' AS entity_type, position FROM found", extra=FOUND)
def _(s):
    return ingest.extract_entities(s.episodes(), dictionary(s))


@register("extract_relations", """
    SELECT episode_uuid, source, 'RELATED_TO' AS relation, target, source || ' is mentioned with ' || target AS fact FROM chain WHERE target IS NOT NULL""", extra=CHAIN)
def _(s):
    return ingest.extract_relations(ingest.extract_entities(s.episodes(), dictionary(s))).drop("user_id")


EMB = """
    h AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b FROM (SELECT doc_id, unnest(string_split_regex(trim(lower(text), chr(32) || chr(10)), '[ \\n\\t\\r]+')) AS t FROM documents) WHERE t <> ''),
    c AS (SELECT doc_id, b, count(*) AS n FROM h GROUP BY 1, 2)"""


@register("embed_texts", """
    SELECT doc_id, b::INTEGER AS component, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""", extra=EMB)
def _(s):
    """Every component that is not zero, so that whole vectors are compared."""
    out = ingest.embed_texts(s.table("documents").select("doc_id", "text"), "text")
    parts = out.select("doc_id", F.posexplode("embedding").alias("component", "weight")).filter("weight <> 0")
    return parts.withColumn("weight", F.round("weight", 6))


@register("resolve_entities", """
    SELECT q.user_id, q.name, coalesce(e.name, q.name) AS canonical_name, e.uuid IS NULL AS is_new, q.mentions FROM (
      SELECT user_id, lower(replace(name, ' ', '_')) AS name, any_value(query_id) AS query_id, count(*) AS mentions FROM (
        SELECT user_id, 'Topic ' || query_id AS name, query_id FROM fx_queries UNION ALL SELECT user_id, 'topic ' || query_id, query_id FROM fx_queries) GROUP BY 1, 2) q
    LEFT JOIN hit ON hit.query_id = q.query_id AND hit.rank = 1 LEFT JOIN fx_entities e ON e.uuid = hit.uuid""",
          extra=f"hit AS ({sim_sql('SELECT * FROM fx_entities', 'name_embedding', 1).replace('(q.user_id IS NULL OR q.user_id = c.user_id)', 'q.user_id = c.user_id')})")
def _(s):
    q = s.queries().select("user_id", F.concat(F.lit("Topic "), "query_id").alias("name"), F.lit("TOPIC").alias("entity_type"), "embedding")
    found = q.unionByName(q.withColumn("name", F.lower("name")))
    return ingest.resolve_entities(found, s.entities(), threshold=T).select("user_id", "name", "canonical_name", "is_new", "mentions")


@register("resolve_relations", f"""
    SELECT source_uuid, target_uuid, fact, mentions, is_new, CASE WHEN NOT is_new THEN uuid END AS reused FROM (
      SELECT n.source_uuid, n.target_uuid, n.fact, n.mentions, e.uuid, e.uuid IS NULL AS is_new,
             row_number() OVER (PARTITION BY n.source_uuid, n.target_uuid, n.fact ORDER BY round(list_cosine_similarity(n.v, e.fact_embedding::DOUBLE[]), 6) DESC, e.uuid) AS rn
      FROM (SELECT a.uuid AS source_uuid, b.uuid AS target_uuid, f.fact, count(*) AS mentions, any_value(f.v) AS v FROM facts f
            JOIN names a ON a.name = f.source JOIN names b ON b.name = f.target GROUP BY 1, 2, 3) n
      LEFT JOIN (SELECT * FROM fx_edges WHERE {ACTIVE}) e ON e.source_uuid = n.source_uuid AND e.target_uuid = n.target_uuid
           AND round(list_cosine_similarity(n.v, e.fact_embedding::DOUBLE[]), 6) >= 0.8) WHERE rn = 1""", extra="""
    names AS (SELECT name, min(uuid) AS uuid FROM fx_entities GROUP BY 1),
    facts AS (SELECT a.name AS source, CASE WHEN e.mentions > 1 THEN b.name ELSE b.name || '?' END AS target, 'again ' || e.uuid AS fact, fact_embedding::DOUBLE[] AS v
              FROM fx_edges e JOIN fx_entities a ON a.uuid = e.source_uuid JOIN fx_entities b ON b.uuid = e.target_uuid)""")
def _(s):
    ents, edges = stage(s.entities().select("uuid", "name")), stage(s.plain_edges().drop("user_id"))
    names = joins.edges_with_names(edges, ents)
    target = F.when(F.col("mentions") > 1, F.col("target_name")).otherwise(F.concat("target_name", F.lit("?")))
    found = names.select(F.lit("all").alias("user_id"), F.col("source_name").alias("source"), target.alias("target"), F.col("name").alias("relation"),
                         F.concat(F.lit("again "), "uuid").alias("fact"), "vec_id")
    vectors = s.table("embeddings").select("vec_id", F.col("embedding").alias("vec"))
    out = ingest.resolve_relations(found, ents.withColumn("user_id", F.lit("all")), edges, reference_time=ERT, vectors=vectors)
    return out.select("source_uuid", "target_uuid", "fact", "mentions", "is_new", F.when(~F.col("is_new"), F.col("uuid")).alias("reused"))


@register("build_mentions", "SELECT episode_uuid, entity_uuid, min(created_at) AS created_at FROM fx_mentions GROUP BY 1, 2")
def _(s):
    m = s.mentions()
    return ingest.build_mentions(m.unionByName(m)).select("episode_uuid", "entity_uuid", "created_at")


@register("invalidate_contradictions", """
    SELECT uuid, CASE WHEN nxt IS NOT NULL THEN nxt ELSE invalid_at END AS invalid_at, CASE WHEN nxt IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE expired_at END AS expired_at FROM (
      SELECT *, CASE WHEN expired_at IS NULL AND name = 'SUPPLIES' THEN lead(valid_at) OVER (PARTITION BY source_uuid, name, expired_at IS NULL ORDER BY valid_at, uuid) END AS nxt FROM fx_edges)""")
def _(s):
    return ingest.invalidate_contradictions(stage(s.edges()), ["SUPPLIES"], "2024-03-01").select("uuid", "invalid_at", "expired_at")


@register("update_summaries", f"""
    SELECT uuid, name, coalesce(context, summary) AS summary FROM fx_entities LEFT JOIN (
      SELECT entity_uuid, string_agg('- ' || relation || ': ' || other, chr(10) ORDER BY rn) AS context FROM (
        SELECT r.entity_uuid, r.relation, o.name AS other, row_number() OVER (PARTITION BY r.entity_uuid ORDER BY r.valid_at DESC, r.uuid) AS rn FROM (
          SELECT source_uuid AS entity_uuid, target_uuid AS other_uuid, name AS relation, valid_at, uuid FROM fx_edges WHERE {ACTIVE} UNION ALL
          SELECT target_uuid, source_uuid, name, valid_at, uuid FROM fx_edges WHERE {ACTIVE}) r JOIN fx_entities o ON o.uuid = r.other_uuid) WHERE rn <= 5 GROUP BY 1) c ON c.entity_uuid = uuid""")
def _(s):
    ents = s.entities()
    rel = joins.entity_relationships(ents, s.edges(), reference_time=ERT)
    return ingest.update_summaries(ents, ingest.summary_context(ents, rel)).select("uuid", "name", "summary")


@register("link_episode_edges", """
    SELECT 'o' || o_orderkey AS uuid, array_to_string(es, ',') AS entity_edges FROM orders
    LEFT JOIN (SELECT ep, list_sort(list_distinct(list(uuid))) AS es FROM (SELECT uuid, unnest(episodes) AS ep FROM fx_edges) GROUP BY 1) ON ep = 'o' || o_orderkey""")
def _(s):
    eps = s.table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("uuid"))
    return ingest.link_episode_edges(eps, s.edges()).withColumn("entity_edges", F.array_join("entity_edges", ","))


# ---- maintenance --------------------------------------------------------------------------------

PRUNED = f"(expired_at IS NULL OR expired_at >= TIMESTAMP '{ERT}' - INTERVAL 90 DAY)"
WEAK = f"SELECT uuid FROM fx_entities WHERE mentions < 25 AND created_at < TIMESTAMP '{ERT}' - INTERVAL 30 DAY"


@register("prune_expired_edges", f"SELECT uuid FROM fx_edges WHERE {PRUNED}")
def _(s):
    return maintain.prune_expired_edges(s.edges(), reference_time=ERT).select("uuid")


@register("prune_low_mention_entities", f"""
    SELECT 'entity' AS kind, uuid FROM fx_entities WHERE uuid NOT IN ({WEAK}) UNION ALL
    SELECT 'edge', uuid FROM fx_edges WHERE source_uuid NOT IN ({WEAK}) AND target_uuid NOT IN ({WEAK}) UNION ALL
    SELECT 'mention', uuid FROM fx_mentions WHERE entity_uuid NOT IN ({WEAK})""")
def _(s):
    n, e, m = maintain.prune_low_mention_entities(s.entities(), s.edges(), s.mentions(), reference_time=ERT, min_mentions=25)
    return (n.select(F.lit("entity").alias("kind"), "uuid").unionByName(e.select(F.lit("edge").alias("kind"), "uuid"))
            .unionByName(m.select(F.lit("mention").alias("kind"), "uuid")))


def _compact_sql(edges: str, p: str) -> str:
    """Greedy merge inside endpoint pairs; a pair has at most three facts with vectors."""
    sim = "round(list_cosine_similarity({}.fact_embedding::DOUBLE[], {}.fact_embedding::DOUBLE[]), 6) >= 0.95"
    return f"""
    {p}o AS (SELECT *, least(source_uuid, target_uuid) AS a, greatest(source_uuid, target_uuid) AS b,
             row_number() OVER (PARTITION BY least(source_uuid, target_uuid), greatest(source_uuid, target_uuid) ORDER BY created_at, uuid) AS rn FROM ({edges}) WHERE fact_embedding IS NOT NULL),
    {p}m AS (SELECT z.uuid, CASE WHEN z.rn = 2 THEN CASE WHEN {sim.format('x', 'z')} THEN x.uuid END
                 WHEN z.rn = 3 THEN CASE WHEN {sim.format('x', 'z')} THEN x.uuid WHEN NOT ({sim.format('x', 'y')}) AND {sim.format('y', 'z')} THEN y.uuid END END AS keeper
             FROM {p}o z JOIN {p}o x ON x.a = z.a AND x.b = z.b AND x.rn = 1 LEFT JOIN {p}o y ON y.a = z.a AND y.b = z.b AND y.rn = 2),
    {p}merged AS (SELECT uuid, keeper FROM {p}m WHERE keeper IS NOT NULL)"""


@register("compact_redundant_edges", """
    SELECT e.uuid, (e.mentions + coalesce(g.mentions, 0))::BIGINT AS mentions, array_to_string(CASE WHEN g.eps IS NULL THEN e.episodes ELSE list_sort(list_distinct(list_concat(e.episodes, g.eps))) END, ',') AS episodes
    FROM fx_edges e LEFT JOIN (SELECT keeper, sum(x.mentions) AS mentions, flatten(list(x.episodes)) AS eps FROM merged JOIN fx_edges x ON x.uuid = merged.uuid GROUP BY 1) g ON g.keeper = e.uuid
    WHERE e.uuid NOT IN (SELECT uuid FROM merged)""", extra=_compact_sql("SELECT * FROM fx_edges", ""))
def _(s):
    out = maintain.compact_redundant_edges(s.edges())
    return out.select("uuid", "mentions", F.array_join("episodes", ",").alias("episodes"))


@register("redundant_edge_pairs", "SELECT uuid AS id, keeper FROM merged", extra=_compact_sql("SELECT * FROM fx_edges", ""))
def _(s):
    return maintain.redundant_edges(s.edges()).filter("id <> keeper").select("id", "keeper")


@register("prune_all", f"""
    SELECT (SELECT count(*) FROM fx_edges WHERE NOT {PRUNED}) AS expired_edges_deleted, (SELECT count(*) FROM weak) AS entities_deleted,
           (SELECT count(*) FROM merged) AS edges_merged""", extra=f"""
    weak AS ({WEAK}),""" + _compact_sql(f"SELECT * FROM fx_edges WHERE {PRUNED} AND source_uuid NOT IN (SELECT uuid FROM weak) AND target_uuid NOT IN (SELECT uuid FROM weak)", ""))
def _(s):
    return maintain.prune_all(stage(s.entities()), s.edges(), s.mentions(), reference_time=ERT, min_mentions=25)[1]


MINE = "SELECT uuid FROM fx_entities WHERE user_id = 'u_de'"


@register("delete_user", f"""
    SELECT 'episodes' AS tbl, count(*) AS n FROM fx_episodes WHERE user_id <> 'u_de' UNION ALL SELECT 'entities', count(*) FROM fx_entities WHERE user_id <> 'u_de' UNION ALL
    SELECT 'edges', count(*) FROM fx_edges WHERE source_uuid NOT IN ({MINE}) AND target_uuid NOT IN ({MINE}) UNION ALL
    SELECT 'mentions', count(*) FROM fx_mentions WHERE entity_uuid NOT IN ({MINE}) AND episode_uuid NOT IN (SELECT uuid FROM fx_episodes WHERE user_id = 'u_de')""")
def _(s):
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("tbl"), "n") for k, df in
             maintain.delete_user(s.episodes(), stage(s.entities()), s.edges(), s.mentions(), "u_de").items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("delete_instruction", """
    SELECT uuid, uuid IN (SELECT uuid FROM fx_instructions) AS deleted FROM (SELECT DISTINCT 'i' || o_custkey AS uuid FROM orders UNION SELECT 'i' || (o_custkey + 1000000) FROM orders)""")
def _(s):
    o = s.table("orders")
    keys = o.select(F.concat(F.lit("i"), "o_custkey").alias("uuid")).unionByName(o.select(F.concat(F.lit("i"), F.col("o_custkey") + 1000000).alias("uuid")))
    return maintain.delete_instructions(s.instructions(), keys)[1]


@register("reset_graph", "SELECT 'entities' AS name, count(*) AS n_before, 0::BIGINT AS n_after FROM fx_entities UNION ALL SELECT 'edges', count(*), 0 FROM fx_edges")
def _(s):
    full, root = {"entities": s.entities(), "edges": s.edges()}, fresh_path(s.spark, "reset")
    write_snapshot(maintain.reset_graph(full), root, "v1")
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n_before")).withColumn(
        "n_after", F.lit(s.spark.read.schema(df.schema).parquet(f"{root}/v1/{name}").count()).cast("long")) for name, df in full.items()]
    return counts[0].unionByName(counts[1])


GONE = "SELECT uuid FROM fx_episodes WHERE user_id = 'u_en'"


@register("delete_episode", f"""
    SELECT (SELECT count(*) FROM fx_episodes WHERE user_id = 'u_en') AS episodes_deleted, (SELECT count(*) FROM fx_entities WHERE uuid IN (SELECT uuid FROM orph)) AS entities_deleted,
           (SELECT count(*) FROM fx_edges WHERE source_uuid IN (SELECT uuid FROM orph) OR target_uuid IN (SELECT uuid FROM orph)) AS edges_deleted""", extra=f"""
    orph AS (SELECT entity_uuid AS uuid FROM fx_mentions GROUP BY 1 HAVING bool_and(episode_uuid IN ({GONE})))""")
def _(s):
    gone = s.episodes().filter("user_id = 'u_en'").select("uuid")
    return maintain.delete_episodes(s.episodes(), stage(s.entities()), stage(s.edges()), s.mentions(), gone)[1]


# ---- communities --------------------------------------------------------------------------------

_ADJ = "adj AS (SELECT DISTINCT a, b FROM (SELECT source_uuid AS a, target_uuid AS b FROM fx_edges UNION ALL SELECT target_uuid, source_uuid FROM fx_edges) WHERE a <> b)"
# nations, suppliers and parts: no shortest way is longer than these rounds
_CC = _ADJ + ", c0 AS (SELECT DISTINCT a AS uuid, a AS component FROM adj)" + "".join(
    f", c{i + 1} AS MATERIALIZED (SELECT a AS uuid, min(least(x.component, y.component)) AS component FROM adj JOIN c{i} x ON x.uuid = a JOIN c{i} y ON y.uuid = b GROUP BY 1)" for i in range(12))


@register("connected_components", "SELECT uuid, component FROM c12", extra=_CC)
def _(s):
    return community.connected_components(s.plain_edges())


_LP = _ADJ + ", l0 AS (SELECT DISTINCT a AS uuid, a AS label FROM adj)"
for _i in range(3):
    _LP += (f", l{_i + 1} AS MATERIALIZED (SELECT uuid, label FROM (SELECT uuid, label, row_number() OVER (PARTITION BY uuid ORDER BY n DESC, label) AS rn FROM ("
            f"SELECT a AS uuid, label, count(*) AS n FROM adj JOIN l{_i} ON l{_i}.uuid = b GROUP BY 1, 2)) WHERE rn = 1)")


@register("label_propagation", "SELECT uuid, label FROM l3", extra=_LP)
def _(s):
    return community.label_propagation(s.plain_edges())


@register("modularity_score", """
    SELECT count(*) AS communities, round(sum(inside / m - (degree / m) ** 2), 6) AS modularity FROM (
      SELECT x.label, count(*) AS degree, count(*) FILTER (x.label = y.label) AS inside, (SELECT count(*) FROM adj)::DOUBLE AS m
      FROM adj JOIN l3 x ON x.uuid = a JOIN l3 y ON y.uuid = b GROUP BY 1)""", extra=_LP)
def _(s):
    e = stage(s.plain_edges().select("source_uuid", "target_uuid").distinct())
    return community.modularity_score(e, community.label_propagation(e)).withColumn("modularity", F.round("modularity", 6))


@register("louvain")
def _(s):
    """Iterative and without a unique answer: tests compare its modularity with brute force and with label propagation."""
    return louvain.louvain(s.plain_edges().select("source_uuid", "target_uuid"), min_community_size=2)


@register("community_table", "SELECT label AS community_id, count(*) AS member_count FROM l3 GROUP BY 1 HAVING count(*) >= 2", extra=_LP)
def _(s):
    return community.community_table(community.label_propagation(s.edges()), min_size=2)

