"""Sources, filters, scalars, joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import privacy, scoring, text, values
from palimpsest.operators import aggregates, filters, joins, sets, windows
from palimpsest.operators.skew import broadcast_if_small
from palimpsest.plans.registry import register
from palimpsest.session import stage
from palimpsest.sources import tables
from palimpsest.sources.standins import EDGE_REFERENCE_TIME as ERT, REFERENCE_TIME as RT, Standins
from palimpsest.streaming.incremental import fresh_path

EDGE_COLS = "uuid, source_uuid, target_uuid, name, fact, created_at, valid_at, invalid_at, expired_at, mentions"
EP_COLS = "uuid, name, source, kind, created_at, user_id"
TOK = (r"list_filter(string_split_regex(lower({}), "
       r"'[\t\n\x0B\f\r\x1c-\x1f \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda t: t <> '')")
TAGS = "list_transform(from_json(metadata, '{\"tags\":[\"VARCHAR\"]}').tags, lambda t: lower(t))"


def tok(expr: str) -> str:
    return TOK.format(expr)


def cols(text_list: str) -> list[str]:
    return [c.strip() for c in text_list.split(",")]


# ---- sources ------------------------------------------------------------------------------------

@register("scan_graph_tables", """
    SELECT 'episodes' AS tbl, count(*) AS n, count(DISTINCT uuid) AS n_keys FROM fx_episodes UNION ALL
    SELECT 'entities', count(*), count(DISTINCT uuid) FROM fx_entities UNION ALL
    SELECT 'edges', count(*), count(DISTINCT uuid) FROM fx_edges UNION ALL
    SELECT 'mentions', count(*), count(DISTINCT uuid) FROM fx_mentions UNION ALL
    SELECT 'triggered', count(*), count(DISTINCT uuid) FROM fx_triggered""")
def _(s: Standins):
    """The graph's tables written as a snapshot, then scanned with their declared schema."""
    root = fresh_path(s.spark, "graph")
    tables.write_snapshot({"episodes": s.episodes(), "entities": s.entities(), "edges": s.edges(), "mentions": s.mentions(),
                           "triggered": s.triggered()}, root, "v1")
    parts = [df.agg(F.count("*").alias("n"), F.countDistinct("uuid").alias("n_keys")).select(F.lit(n).alias("tbl"), "n", "n_keys")
             for n, df in tables.scan_graph(s.spark, f"{root}/v1").items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("parse_metadata", """
    SELECT episode_uuid AS uuid, count(DISTINCT session_id) AS n_sessions, count(DISTINCT run_id) AS n_runs,
           count(*) AS n_calls, 'adk' AS integration FROM fx_tool_calls GROUP BY 1""")
def _(s):
    meta = joins.metadata_struct(s.query_episodes())
    runs = F.flatten(F.map_values("meta.sessions"))
    return meta.select("uuid", F.size("meta.sessions").cast("long").alias("n_sessions"),
                       F.size(runs).cast("long").alias("n_runs"),
                       F.size(F.flatten(F.transform(runs, lambda r: r["tools_used"]))).cast("long").alias("n_calls"),
                       F.col("meta.integration").alias("integration"))


@register("ingest_batch_source", """
    SELECT 'c' || conv_id || '_' || turn AS source_key, text AS content, 'text' AS source, 'query' AS kind,
           TIMESTAMP '2024-02-01' AS created_at, 's' || conv_id AS session_id, 's' || conv_id AS sessions,
           CASE WHEN turn % 2 = 0 THEN 't' || turn END AS topic FROM conversations""")
def _(s):
    raw = s.table("conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("source_key"), F.col("text").alias("content"),
        F.concat(F.lit("s"), "conv_id").alias("session_id"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"topic":"t'), "turn", F.lit('"}'))).alias("metadata"))
    out = tables.batch_to_episodes(raw, reference_time=RT)
    keys = F.array_join(F.map_keys(F.from_json("metadata", "sessions map<string,string>")["sessions"]), ",")
    return out.select("source_key", "content", "source", "kind", "created_at", "session_id", keys.alias("sessions"),
                      F.get_json_object("metadata", "$.topic").alias("topic"))


@register("message_source", """
    SELECT 'c' || conv_id || '_' || turn AS source_key, role || ': ' || text AS content, 'message' AS source FROM conversations""")
def _(s):
    turns = s.table("conversations").withColumn("source_key", F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn"))
    return tables.messages_to_episodes(turns, actor="role", text="text").select("source_key", "content", "source")


_ENDS = "LEFT JOIN {0} a ON a.uuid = x.{1} LEFT JOIN {2} b ON b.uuid = x.{3}"


@register("export_graph_json", f"""
    SELECT 'episodes' AS tbl, uuid, name AS label, NULL::VARCHAR AS first_name, NULL::VARCHAR AS second_name, created_at FROM fx_episodes UNION ALL
    SELECT 'entities', uuid, name, NULL, NULL, created_at FROM fx_entities UNION ALL
    SELECT 'edges', x.uuid, x.fact, coalesce(a.name, 'Unknown'), coalesce(b.name, 'Unknown'), x.created_at FROM fx_edges x {_ENDS.format('fx_entities', 'source_uuid', 'fx_entities', 'target_uuid')} UNION ALL
    SELECT 'mentions', x.uuid, NULL, coalesce(a.name, 'Unknown'), coalesce(b.name, 'Unknown'), x.created_at FROM fx_mentions x {_ENDS.format('fx_episodes', 'episode_uuid', 'fx_entities', 'entity_uuid')} UNION ALL
    SELECT 'triggered', x.uuid, NULL, coalesce(a.name, 'Unknown'), coalesce(b.name, 'Unknown'), NULL FROM fx_triggered x {_ENDS.format('fx_episodes', 'source_uuid', 'fx_episodes', 'target_uuid')} UNION ALL
    SELECT 'communities', 't_' || entity_type, 'Community ' || entity_type, NULL, NULL, NULL FROM (SELECT DISTINCT entity_type FROM fx_entities) UNION ALL
    SELECT 'members', 'h' || uuid, NULL, 'Community ' || entity_type, name, NULL FROM fx_entities""")
def _(s):
    """All tables written as JSON and read back: what each document is called and what it links."""
    ents = stage(s.entities())
    key = F.concat(F.lit("t_"), "entity_type")
    named = {"episodes": s.episodes(), "entities": ents, "edges": s.plain_edges().drop("user_id"), "mentions": s.mentions(), "triggered": s.triggered(),
             "communities": ents.select(key.alias("uuid"), F.concat(F.lit("Community "), "entity_type").alias("name")).distinct(),
             "members": ents.select(F.concat(F.lit("h"), "uuid").alias("uuid"), key.alias("community_uuid"), F.col("uuid").alias("entity_uuid"))}
    root = fresh_path(s.spark, "export")
    tables.export_graph_json(named, root, wide={"edges": s.with_vectors})
    wanted = {"episodes": ("name", None, None), "entities": ("name", None, None), "edges": ("fact", "source_name", "target_name"),
              "mentions": (None, "episode_name", "entity_name"), "triggered": (None, "source_name", "target_name"),
              "communities": ("name", None, None), "members": (None, "community_name", "entity_name")}
    out = None
    for tbl, names in wanted.items():
        doc = s.spark.read.text(f"{root}/{tbl}").select(F.from_json("value", "map<string,string>").alias("j"))
        part = doc.select(F.lit(tbl).alias("tbl"), F.col("j.uuid").alias("uuid"),
                          *[(F.col("j")[c] if c else F.lit(None).cast("string")).alias(n) for c, n in zip(names, ("label", "first_name", "second_name"))],
                          F.col("j.created_at").cast("timestamp").alias("created_at"))
        out = part if out is None else out.unionByName(part)
    return out


@register("list_all_entities", "SELECT uuid, name, entity_type, summary, mentions, created_at, user_id FROM fx_entities WHERE user_id = 'u_en'")
def _(s):
    return filters.by_user(s.entities(), "u_en").drop("name_embedding")


@register("list_all_edges", f"""
    SELECT {', '.join('e.' + c.strip() for c in EDGE_COLS.split(','))} FROM fx_edges e
    JOIN fx_entities a ON a.uuid = e.source_uuid JOIN fx_entities b ON b.uuid = e.target_uuid
    WHERE a.user_id = 'u_en' AND b.user_id = 'u_en'""")
def _(s):
    return tables.list_edges(s.edges(), s.entities(), user_id="u_en").select(*cols(EDGE_COLS))


@register("list_tools", "SELECT * FROM fx_tools ORDER BY tool_name")
def _(s):
    return s.tools().orderBy("tool_name")


# ---- filters ------------------------------------------------------------------------------------

@register("filter_user", f"SELECT {EP_COLS} FROM fx_episodes WHERE user_id = 'u_fr'")
def _(s):
    return filters.by_user(filters.by_user(s.episodes(), ""), "u_fr").select(*cols(EP_COLS))


@register("filter_kind", f"SELECT {EP_COLS} FROM fx_episodes WHERE kind IN ('query')")
def _(s):
    return filters.by_kind(s.episodes(), ["QUERY"]).select(*cols(EP_COLS))


@register("filter_time_cutoff", f"SELECT {EP_COLS} FROM fx_episodes WHERE created_at > TIMESTAMP '2024-01-03'")
def _(s):
    return filters.after(s.episodes(), "2024-01-03").select(*cols(EP_COLS))


@register("filter_date_range", f"SELECT {EP_COLS} FROM fx_episodes WHERE created_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04 12:00:00'")
def _(s):
    return filters.in_date_range(s.episodes(), "2024-01-02", "2024-01-04 12:00:00").select(*cols(EP_COLS))


@register("filter_contains", f"SELECT {EP_COLS} FROM fx_episodes WHERE contains(content, 'The')")
def _(s):
    return filters.content_contains(s.episodes(), "The").select(*cols(EP_COLS))


@register("filter_entity_text", "SELECT uuid, name, summary FROM fx_entities WHERE contains(lower(name), 'machin') OR contains(lower(summary), 'machin')")
def _(s):
    return filters.entity_text_contains(s.entities(), "Machin").select("uuid", "name", "summary")


@register("filter_tag_text", f"SELECT {EP_COLS} FROM fx_episodes WHERE len(list_filter({TAGS}, lambda t: contains(t, 'src1'))) > 0")
def _(s):
    return filters.tag_text_contains(s.episodes(), "Src1").select(*cols(EP_COLS))


@register("filter_tags_any", f"SELECT {EP_COLS} FROM fx_episodes WHERE list_has_any({TAGS}, ['fr', 'src3'])")
def _(s):
    return filters.by_tags(s.episodes(), ["FR", "SRC3"]).select(*cols(EP_COLS))


@register("filter_tags_all", f"SELECT {EP_COLS} FROM fx_episodes WHERE list_has_all({TAGS}, ['en', 'src3'])")
def _(s):
    return filters.by_tags(s.episodes(), ["en", "Src3"], "all").select(*cols(EP_COLS))


@register("filter_active_edges", f"SELECT {EDGE_COLS} FROM fx_edges WHERE expired_at IS NULL OR expired_at > TIMESTAMP '{ERT}'")
def _(s):
    return filters.active_edges(s.edges(), ERT).select(*cols(EDGE_COLS))


@register("filter_source_type", f"SELECT {EP_COLS} FROM fx_episodes WHERE source = 'message'")
def _(s):
    return filters.by_source_type(s.episodes(), "message").select(*cols(EP_COLS))


@register("filter_entity_type", "SELECT uuid, name FROM fx_entities WHERE entity_type = 'PART'")
def _(s):
    return filters.by_entity_type(s.entities(), "PART").select("uuid", "name")


@register("filter_relation_type", f"SELECT {EDGE_COLS} FROM fx_edges WHERE name = 'LOCATED_IN'")
def _(s):
    return filters.by_relation_type(s.edges(), "LOCATED_IN").select(*cols(EDGE_COLS))


@register("filter_only_augmented", """
    SELECT episode_uuid AS uuid, count(*) AS n_runs, max(augmented_query) AS augmented_query FROM fx_runs
    WHERE augmented_query <> '' AND augmented_query <> question GROUP BY 1""")
def _(s):
    meta = joins.metadata_struct(s.query_episodes()).withColumn("runs", F.flatten(F.map_values("meta.sessions")))
    return filters.only_augmented(meta).select(
        "uuid", F.size("runs").cast("long").alias("n_runs"),
        F.array_max(F.transform("runs", lambda r: r["augmented_query"])).alias("augmented_query"))


@register("lookup_by_uuid", """
    SELECT e.uuid, e.name, e.entity_type, e.mentions FROM fx_entities e
    WHERE e.uuid IN (SELECT entity_uuid FROM fx_mentions)""")
def _(s):
    return filters.lookup(s.entities(), s.mentions().select("entity_uuid")).select("uuid", "name", "entity_type", "mentions")


@register("lookup_tool", "SELECT * FROM fx_tools WHERE tool_name IN (SELECT p_name FROM part WHERE p_size > 40)")
def _(s):
    keys = s.table("part").filter("p_size > 40").select("p_name")
    return filters.lookup(s.tools(), keys, "tool_name").select("uuid", "tool_name", "description", "mentions")


@register("lookup_by_session", """
    SELECT session_id, (min((created_at, uuid))).uuid AS uuid, min(created_at) AS created_at
    FROM (SELECT DISTINCT r.session_id, {'created_at': e.created_at, 'uuid': e.uuid} AS x, e.created_at, e.uuid
          FROM fx_runs r JOIN fx_query_episodes e ON e.uuid = r.episode_uuid) GROUP BY 1""".replace(
    "(min((created_at, uuid))).uuid", "min(x).uuid"))
def _(s):
    sessions = s.tool_calls().select("session_id").distinct()
    return filters.lookup_by_session(s.query_episodes(), sessions)


# ---- scalars ------------------------------------------------------------------------------------

@register("tokenize", f"""
    SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, sha256(array_to_string(t, ' ')) AS tokens_key
    FROM (SELECT doc_id, {tok('text')} AS t FROM documents)""")
def _(s):
    return s.table("documents").select("doc_id", text.tokenize(F.col("text")).alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
        F.sha2(F.array_join("t", " "), 256).alias("tokens_key"))


@register("episode_doc_text", """
    SELECT e.uuid, concat_ws(' ', content, m) AS doc FROM fx_query_episodes e
    JOIN (SELECT episode_uuid, string_agg(llm_saved_memory, ' ' ORDER BY session_id, run_id) FILTER (llm_saved_memory <> '') AS m
          FROM fx_runs GROUP BY 1) r ON r.episode_uuid = e.uuid""".replace("concat_ws(' ', content, m)", "content || ' ' || coalesce(m, '')"))
def _(s):
    meta = joins.metadata_struct(s.query_episodes())
    return meta.select("uuid", text.episode_doc_text(F.col("content"), F.col("meta.sessions")).alias("doc"))


@register("entity_doc_text", "SELECT uuid, name || ' ' || summary AS doc FROM fx_entities")
def _(s):
    return s.entities().select("uuid", text.entity_doc_text(F.col("name"), F.col("summary")).alias("doc"))


@register("normalize_entity_name", "SELECT s_suppkey, replace(lower(s_name), ' ', '_') AS norm FROM supplier UNION ALL SELECT p_partkey, replace(lower(p_name), ' ', '_') FROM part")
def _(s):
    return s.table("supplier").select("s_suppkey", text.normalize_entity_name(F.col("s_name")).alias("norm")).union(
        s.table("part").select("p_partkey", text.normalize_entity_name(F.col("p_name"))))


@register("normalize_type", "SELECT o_orderkey, replace(upper(o_orderpriority), ' ', '_') AS norm FROM orders")
def _(s):
    return s.table("orders").select("o_orderkey", text.normalize_type(F.col("o_orderpriority")).alias("norm"))


@register("clean_embed_text", r"SELECT doc_id, trim(replace(text, chr(10), ' ')) AS clean FROM documents")
def _(s):
    return s.table("documents").select("doc_id", text.clean_embed_text(F.col("text")).alias("clean"))


@register("entity_embed_text", "SELECT uuid, name || ' (' || entity_type || ')' AS t FROM fx_entities")
def _(s):
    return s.entities().select("uuid", text.entity_embed_text(F.col("name"), F.col("entity_type")).alias("t"))


@register("cosine_similarity", """
    SELECT uuid, round(list_cosine_similarity(fact_embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
    FROM fx_edges JOIN part ON target_uuid = 'p' || p_partkey JOIN embeddings b ON b.vec_id = p_partkey""")
def _(s):
    ents = s.entities().filter(F.col("name_embedding").isNotNull()).select(F.col("uuid").alias("target_uuid"), "name_embedding")
    sim = scoring.cosine_similarity(F.col("fact_embedding"), F.col("name_embedding"))
    # Facts whose target has a vector are found by their ids; only they get their own, and only they move with it.
    facts = s.plain_edges().select("uuid", "target_uuid", "vec_id").join(broadcast_if_small(ents.select("target_uuid")), "target_uuid", "left_semi")
    return s.fact_vectors(facts).join(broadcast_if_small(ents), "target_uuid").select("uuid", scoring.as_score(sim).alias("sim"))


@register("temporal_decay", f"""
    SELECT uuid, round(mentions * pow(0.95, greatest(0, date_diff('second', created_at, TIMESTAMP '{ERT}') // 86400)), 6) AS score FROM fx_edges""")
def _(s):
    return s.edges().select("uuid", scoring.as_score(scoring.temporal_decay(F.col("mentions"), F.col("created_at"), ERT)).alias("score"))


@register("update_boost", f"""
    SELECT uuid, round(CASE WHEN created_at >= TIMESTAMP '{ERT}' - INTERVAL 45 DAY THEN mentions * 1.2
        WHEN invalid_at >= TIMESTAMP '{ERT}' - INTERVAL 45 DAY THEN mentions * 0.96 ELSE mentions END, 6)::DOUBLE AS score FROM fx_edges""")
def _(s):
    b = scoring.update_boost(F.col("mentions").cast("double"), F.col("created_at"), ERT, invalid_at=F.col("invalid_at"), recent_days=45)
    return s.edges().select("uuid", scoring.as_score(b).alias("score"))


def _pii_sql(expr: str) -> str:
    for pattern, label in privacy.PII_PATTERNS:
        expr = f"regexp_replace({expr}, '{pattern}', '{label}', 'g')"
    return expr


@register("pii_mask", f"SELECT doc_id, {_pii_sql('text')} AS masked FROM documents")
def _(s):
    return s.table("documents").select("doc_id", privacy.pii_mask(F.col("text")).alias("masked"))


@register("redact_params", f"""
    SELECT event_id, '[REDACTED]' AS token, {_pii_sql("event_type || ' k=' || k")} AS note
    FROM (SELECT *, (props->>'$.k') AS k FROM events)""")
def _(s):
    k = F.get_json_object("props", "$.k")
    params = F.create_map(F.lit("Token"), k, F.lit("note"), F.concat("event_type", F.lit(" k="), k))
    return s.table("events").select("event_id", privacy.redact_params(params).alias("p")).select(
        "event_id", F.col("p")["Token"].alias("token"), F.col("p")["note"].alias("note"))


_CUT = "CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || '... [truncated, total length: ' || length(text) || ']' ELSE text END"


@register("summarize_output", f"SELECT doc_id, {_pii_sql(_CUT)} AS out FROM documents")
def _(s):
    return s.table("documents").select("doc_id", privacy.summarize_output(F.col("text")).alias("out"))


@register("mask_sensitive", "SELECT key, CASE WHEN length(value) > 10 THEN value[1:4] || '***' || right(value, 6) ELSE '***' END AS masked FROM fx_config")
def _(s):
    return s.config().select("key", privacy.mask_sensitive(F.col("value")).alias("masked"))


@register("typed_value", """
    SELECT key, CASE WHEN data_type = 'int' THEN try_cast(nullif(value, '') AS BIGINT) END AS int_value,
           CASE WHEN data_type = 'float' THEN try_cast(nullif(value, '') AS DOUBLE) END AS float_value,
           CASE WHEN data_type = 'bool' THEN lower(nullif(value, '')) IN ('true', '1', 'yes') END AS bool_value,
           CASE WHEN data_type = 'list' THEN array_to_string(from_json(value, '["VARCHAR"]'), '|') END AS list_value,
           CASE WHEN data_type = 'string' THEN nullif(value, '') END AS string_value FROM fx_config""")
def _(s):
    t = s.config().select("key", values.typed_value(F.col("value"), F.col("data_type")).alias("t")).select("key", "t.*")
    return t.withColumn("list_value", F.array_join("list_value", "|"))


@register("infer_sensitive", "SELECT key, regexp_matches(lower(key), 'key|secret|token|password') AS sensitive FROM fx_config")
def _(s):
    return s.config().select("key", privacy.infer_sensitive(F.col("key")).alias("sensitive"))


@register("dotted_tool_name", "SELECT event_id, coalesce(parent_tool_name || '.', '') || tool_name AS dotted FROM fx_tool_calls")
def _(s):
    return s.tool_calls().select("event_id", values.dotted_tool_name(F.col("tool_name"), F.col("parent_tool_name")).alias("dotted"))


@register("response_size", "SELECT event_id, CASE WHEN trim(output) IN ('', 'None', 'null', 'N/A') THEN 'None' ELSE length(output) || ' chars' END AS size FROM fx_tool_calls")
def _(s):
    return s.tool_calls().select("event_id", values.response_size(F.col("output")).alias("size"))


@register("tool_usage_summary", """
    SELECT episode_uuid AS uuid, string_agg(tool_name || CASE WHEN k % 11 <> 0 THEN ' with [k=' || k || ']' ELSE '' END || ' -> ' ||
           CASE WHEN output IN ('', 'None') THEN '[]' ELSE output END, ', ' ORDER BY session_id, run_id, ts, event_id) AS summary
    FROM fx_tool_calls GROUP BY 1""")
def _(s):
    meta = joins.metadata_struct(s.query_episodes())
    calls = F.flatten(F.transform(F.flatten(F.map_values("meta.sessions")), lambda r: r["tools_used"]))
    return meta.select("uuid", values.tool_usage_summary(calls).alias("summary"))


@register("simple_tool_summary", """
    SELECT uuid, string_agg(tool_name || CASE WHEN ok <> '' THEN ' with [' || ok || ']' ELSE '' END
        || CASE WHEN bad <> '' THEN CASE WHEN ok <> '' THEN '; failed' ELSE '' END || ' with [' || bad || ']' ELSE '' END
        || CASE WHEN emp <> '' THEN CASE WHEN ok <> '' OR bad <> '' THEN '; returned empty' ELSE ' returned empty' END || ' for [' || emp || ']' ELSE '' END,
        ', ' ORDER BY pos) AS summary
    FROM (SELECT uuid, tool_name, min(pos) AS pos,
                 coalesce(string_agg(entry, ', ' ORDER BY pos) FILTER (NOT blank AND success), '') AS ok,
                 coalesce(string_agg(entry, ', ' ORDER BY pos) FILTER (NOT blank AND NOT success), '') AS bad,
                 coalesce(string_agg(entry, ', ' ORDER BY pos) FILTER (blank), '') AS emp
          FROM (SELECT episode_uuid AS uuid, tool_name, success, output IN ('', 'None') AS blank,
                       row_number() OVER (PARTITION BY episode_uuid ORDER BY session_id, run_id, ts, event_id) AS pos,
                       'k=' || k || ' (response: ' || CASE WHEN output IN ('', 'None') THEN 'None' ELSE length(output) || ' chars' END || ')'
                       || coalesce(' [error: ' || error || ']', '') AS entry
                FROM fx_tool_calls WHERE k % 11 <> 0) GROUP BY 1, 2) GROUP BY 1""")
def _(s):
    meta = joins.metadata_struct(s.query_episodes())
    calls = F.flatten(F.transform(F.flatten(F.map_values("meta.sessions")), lambda r: r["tools_used"]))
    return meta.select("uuid", values.simple_tool_summary(calls).alias("summary")).filter("summary <> ''")


@register("content_key", "SELECT doc_id, sha256('m|64|' || text) AS key FROM documents")
def _(s):
    return s.table("documents").select("doc_id", text.content_key(F.lit("m"), F.lit("64"), F.col("text")).alias("key"))


@register("sample_rows", """
    SELECT event_id, session_id, tool_name FROM fx_tool_calls WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 1000000 < 250000""")
def _(s):
    return s.tool_calls().filter(values.keep_sample(F.col("event_id"), 0.25)).select("event_id", "session_id", "tool_name")


@register("token_overlap", f"""
    SELECT doc_id, item_id, round(len(list_filter(q, lambda w: list_contains(m, w))) / greatest(len(q), len(m)), 6) AS overlap
    FROM (SELECT doc_id, {tok('text')} AS m FROM documents) JOIN (SELECT item_id, {tok('text')} AS q FROM benchmark)
         ON item_id = doc_id % (SELECT count(*) FROM benchmark)""")
def _(s):
    n = s.size("benchmark")
    bench = s.table("benchmark").select("item_id", F.col("text").alias("q"))
    pairs = s.table("documents").withColumn("item_id", F.pmod("doc_id", F.lit(n))).join(bench, "item_id")
    return pairs.select("doc_id", "item_id", scoring.as_score(text.token_overlap(F.col("q"), F.col("text"))).alias("overlap"))


# ---- joins --------------------------------------------------------------------------------------

@register("episode_entities", """
    SELECT m.episode_uuid, m.entity_uuid, e.name AS entity_name, e.entity_type FROM fx_mentions m
    JOIN fx_episodes p ON p.uuid = m.episode_uuid JOIN fx_entities e ON e.uuid = m.entity_uuid""")
def _(s):
    return joins.episode_entities(s.episodes(), s.mentions(), s.entities())


@register("triggered_episodes", """
    SELECT trigger_uuid, uuid, name, source, kind, created_at, rank FROM (
      SELECT t.source_uuid AS trigger_uuid, e.*, (row_number() OVER (PARTITION BY t.source_uuid ORDER BY e.created_at DESC, e.uuid))::INTEGER AS rank
      FROM fx_triggered t JOIN fx_episodes e ON e.uuid = t.target_uuid WHERE e.source = 'message' AND e.metadata IS NOT NULL) WHERE rank <= 10""")
def _(s):
    return joins.triggered_episodes(s.episodes(), s.triggered(), source="message")


_REL = f"""
    SELECT r.entity_uuid, r.other_uuid, r.edge_uuid, r.relation_type, r.direction, o.name AS other_name FROM (
      SELECT source_uuid AS entity_uuid, target_uuid AS other_uuid, uuid AS edge_uuid, name AS relation_type, 'outgoing' AS direction, expired_at FROM fx_edges
      UNION ALL SELECT target_uuid, source_uuid, uuid, name, 'incoming', expired_at FROM fx_edges WHERE source_uuid <> target_uuid) r
    JOIN fx_entities o ON o.uuid = r.other_uuid WHERE (r.expired_at IS NULL OR r.expired_at > TIMESTAMP '{ERT}')"""


@register("entity_relationships", _REL + " AND r.entity_uuid IN (SELECT entity_uuid FROM fx_mentions)")
def _(s):
    seeds = s.mentions().select("entity_uuid")
    return joins.entity_relationships(s.entities(), s.edges(), seeds, reference_time=ERT).select(
        "entity_uuid", "other_uuid", "edge_uuid", "relation_type", "direction", "other_name")


@register("edges_with_names", """
    SELECT e.uuid, coalesce(a.name, 'Unknown') AS source_name, coalesce(b.name, 'Unknown') AS target_name
    FROM fx_edges e LEFT JOIN (SELECT * FROM fx_entities WHERE entity_type <> 'NATION') a ON a.uuid = e.source_uuid
    LEFT JOIN (SELECT * FROM fx_entities WHERE entity_type <> 'NATION') b ON b.uuid = e.target_uuid""")
def _(s):
    known = s.entities().filter("entity_type <> 'NATION'")
    return joins.edges_with_names(s.edges(), known).select("uuid", "source_name", "target_name")


@register("edges_with_result_names", """
    SELECT e.uuid, coalesce(a.name, '') AS source_name, coalesce(b.name, '') AS target_name
    FROM fx_edges e LEFT JOIN (SELECT * FROM fx_entities WHERE uuid IN (SELECT entity_uuid FROM fx_mentions)) a ON a.uuid = e.source_uuid
    LEFT JOIN (SELECT * FROM fx_entities WHERE uuid IN (SELECT entity_uuid FROM fx_mentions)) b ON b.uuid = e.target_uuid""")
def _(s):
    found = filters.lookup(s.entities(), s.mentions().select("entity_uuid"))
    return joins.edges_with_names(s.edges(), found, missing="").select("uuid", "source_name", "target_name")


@register("edge_direction_split", """
    SELECT entity_uuid, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (
      SELECT source_uuid AS entity_uuid, 1 AS o, 0 AS i FROM fx_edges UNION ALL SELECT target_uuid, 0, 1 FROM fx_edges) GROUP BY 1""")
def _(s):
    return joins.edge_direction_counts(s.edges())


@register("orphan_entities", """
    SELECT DISTINCT entity_uuid FROM fx_mentions WHERE episode_uuid IN (SELECT uuid FROM fx_episodes WHERE user_id = 'u_en')
    AND entity_uuid NOT IN (SELECT entity_uuid FROM fx_mentions WHERE episode_uuid NOT IN (SELECT uuid FROM fx_episodes WHERE user_id = 'u_en'))""")
def _(s):
    return joins.orphan_entities(s.mentions(), filters.by_user(s.episodes(), "u_en").select("uuid"))


@register("window_dedup_join", """
    SELECT user_key, tool_name, event_id, prev_id AS previous_uuid, round(gap, 3) AS gap_seconds FROM (
      SELECT user_key, tool_name, event_id, lag(event_id) OVER w AS prev_id,
             epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6 AS gap
      FROM fx_tool_calls WINDOW w AS (PARTITION BY user_key, tool_name ORDER BY ts, event_id)) WHERE gap < 86400""")
def _(s):
    out = joins.window_pairs(s.tool_calls(), keys=["user_key", "tool_name"], ts="ts", ident="event_id")
    return out.withColumn("gap_seconds", F.round("gap_seconds", 3))


# ---- aggregates ---------------------------------------------------------------------------------

@register("graph_stats", """
    SELECT 'episodes' AS metric, count(*) AS n FROM fx_episodes UNION ALL SELECT 'entities', count(*) FROM fx_entities
    UNION ALL SELECT 'relationships', count(*) FROM fx_edges""")
def _(s):
    return aggregates.graph_stats(s.episodes(), s.entities(), s.edges())


@register("index_stats", f"""
    SELECT 'episodes' AS corpus, count(*) AS documents, sum(len({tok('content')}))::BIGINT AS tokens FROM fx_episodes UNION ALL
    SELECT 'entities', count(*), sum(len({tok("name || ' ' || summary")}))::BIGINT FROM fx_entities UNION ALL
    SELECT 'edges', count(*), sum(len({tok('fact')}))::BIGINT FROM fx_edges""")
def _(s):
    def toks(df, c):
        return df.select("uuid", text.tokenize(c).alias("tokens"))
    return aggregates.index_stats(
        episodes=toks(s.episodes(), F.col("content")),
        entities=toks(s.entities(), text.entity_doc_text(F.col("name"), F.col("summary"))),
        edges=toks(s.edges(), F.col("fact")))


@register("distinct_users", "SELECT user_id FROM fx_episodes WHERE user_id IS NOT NULL UNION SELECT user_id FROM fx_entities WHERE user_id IS NOT NULL ORDER BY 1")
def _(s):
    return aggregates.distinct_users(s.entities(), s.episodes())


@register("distinct_entity_types", "SELECT DISTINCT entity_type FROM fx_entities WHERE entity_type <> '' ORDER BY 1")
def _(s):
    return aggregates.distinct_entity_types(s.entities())


@register("entity_type_distribution", "SELECT coalesce(entity_type, 'unknown') AS entity_type, count(*) AS n FROM fx_entities GROUP BY 1")
def _(s):
    return aggregates.entity_type_distribution(s.entities())


@register("embedding_coverage", "SELECT count(*) AS total, count(content_embedding) AS with_embedding FROM fx_episodes")
def _(s):
    return aggregates.embedding_coverage(s.episodes(), "content_embedding")


@register("instructions_by_agent_type", """
    SELECT agent_type, count(*) AS n, count(*) FILTER (memory_enabled) AS memory_enabled,
           max({'t': updated_at, 'u': uuid}).u AS newest_uuid, max(updated_at) AS newest_at FROM fx_instructions GROUP BY 1""")
def _(s):
    return aggregates.instructions_by_agent_type(s.instructions())


@register("time_saved", """
    SELECT round(coalesce(avg(value) FILTER (event_type = 'purchase'), 0), 6) AS avg_saved,
           round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 4) AS total_saved,
           count(*) FILTER (event_type = 'purchase') AS n FROM events""")
def _(s):
    metrics = s.table("events").select((F.col("event_type") == "purchase").alias("used_memory"), F.col("value").alias("time_saved"))
    return aggregates.time_saved(metrics).select(
        F.round("avg_saved", 6).alias("avg_saved"), F.round("total_saved", 4).alias("total_saved"), "n")


@register("episode_page_total", "SELECT count(*) AS total FROM fx_episodes WHERE user_id = 'u_en' AND kind = 'memory'")
def _(s):
    return aggregates.page_total(filters.by_kind(filters.by_user(s.episodes(), "u_en"), ["memory"]))


@register("graph_payload", """
    (SELECT 'node' AS part, uuid, name AS label, NULL::VARCHAR AS source_uuid, NULL::VARCHAR AS target_uuid, (SELECT count(*) FROM fx_entities) AS total
     FROM fx_entities ORDER BY mentions DESC, uuid LIMIT 1000) UNION ALL
    (SELECT 'edge', uuid, name, source_uuid, target_uuid, (SELECT count(*) FROM fx_edges) FROM fx_edges ORDER BY mentions DESC, uuid LIMIT 2000)""")
def _(s):
    return aggregates.graph_payload(s.entities(), s.edges())


# ---- windows and pages --------------------------------------------------------------------------

@register("recent_context", r"""
    SELECT user_id, count(*) AS n, 'Recent context:' || chr(10) || string_agg('- ' || name || ': ' || substring(content, 1, 100) || '...', chr(10) ORDER BY rn) AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, uuid) AS rn FROM fx_episodes) WHERE rn <= 5 GROUP BY 1""")
def _(s):
    return windows.recent_context(s.episodes())


@register("page", f"SELECT {EP_COLS} FROM fx_episodes ORDER BY created_at DESC, uuid LIMIT 50 OFFSET 100")
def _(s):
    return windows.page(s.episodes(), limit=50, offset=100).select(*cols(EP_COLS))


@register("list_instructions", "SELECT * FROM fx_instructions WHERE agent_type = 'MACHINERY' ORDER BY updated_at DESC, uuid LIMIT 50")
def _(s):
    return windows.list_instructions(s.instructions(), agent_type="MACHINERY")


@register("rank_in_list", """
    SELECT lst, uuid, score, (row_number() OVER (PARTITION BY lst ORDER BY score DESC, created_at DESC, uuid))::INTEGER AS rank
    FROM (SELECT name AS lst, uuid, mentions::DOUBLE AS score, created_at FROM fx_edges)""")
def _(s):
    ranked = s.edges().select(F.col("name").alias("lst"), "uuid", F.col("mentions").cast("double").alias("score"), "created_at")
    return windows.rank_in_list(ranked, ["lst"]).drop("created_at")


@register("topk_by_score_recency", """
    SELECT name, uuid, score, created_at, rank FROM (SELECT name, uuid, mentions::DOUBLE AS score, created_at,
      (row_number() OVER (PARTITION BY name ORDER BY mentions DESC, created_at DESC, uuid))::INTEGER AS rank FROM fx_edges) WHERE rank <= 100""")
def _(s):
    df = s.edges().select("name", "uuid", F.col("mentions").cast("double").alias("score"), "created_at")
    return windows.topk_by_score_recency(df, ["name"], 100)


# ---- sets ---------------------------------------------------------------------------------------

@register("union_users", "SELECT user_id FROM fx_episodes UNION SELECT user_id FROM fx_query_episodes")
def _(s):
    return aggregates.distinct_users(s.episodes(), s.query_episodes())


@register("merge_episode_lists", """
    SELECT uuid, array_to_string(list_sort(list_distinct(list_concat(episodes, ['o1', 'x' || mentions]))), ',') AS merged FROM fx_edges""")
def _(s):
    extra = F.array(F.lit("o1"), F.concat(F.lit("x"), "mentions"))
    return s.edges().select("uuid", F.array_join(sets.merge_episode_lists(F.col("episodes"), extra), ",").alias("merged"))


@register("merge_results", """
    SELECT 0::BIGINT AS query_id, 'edge' AS kind, uuid, sum(score) AS score, max(CASE WHEN l = 1 THEN note END) AS note1, count(*) AS n_lists
    FROM (SELECT uuid, mentions::DOUBLE AS score, 'a' AS note, 0 AS l FROM fx_edges
          UNION ALL SELECT uuid, 2.0, 'b', 1 FROM fx_edges WHERE expired_at IS NOT NULL) GROUP BY uuid""".replace(
    "max(CASE WHEN l = 1 THEN note END) AS note1", "arg_max(note, l) AS note"))
def _(s):
    e = s.edges()
    a = e.select(F.lit(0).cast("long").alias("query_id"), F.lit("edge").alias("kind"), "uuid", F.col("mentions").cast("double").alias("score"), F.lit("a").alias("note"))
    b = e.filter("expired_at IS NOT NULL").select(F.lit(0).cast("long").alias("query_id"), F.lit("edge").alias("kind"), "uuid", F.lit(2.0).alias("score"), F.lit("b").alias("note"))
    return sets.merge_results([a, b], ["note"])


@register("dedup_names", """
    SELECT o_orderkey AS doc, replace(lower(p_name), ' ', '_') AS normalized, min(l_linenumber) AS first_line
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def _(s):
    lines = s.table("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("p_partkey"), "l_linenumber")
    named = lines.join(s.table("part").select("p_partkey", "p_name"), "p_partkey").join(
        s.table("orders").select(F.col("o_orderkey").alias("doc")), "doc", "left_semi")
    return sets.dedup_names(named, document="doc", name="p_name", position="l_linenumber").select(
        "doc", "normalized", F.col("l_linenumber").alias("first_line"))

