"""Session, run and tool analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import augment, metadata, runs, search
from palimpsest.operators.run_log import RunLog
from palimpsest.plans.registry import register
from palimpsest.plans.retrieval import bm25_ctes, sim_sql, top
from palimpsest.session import stage
from palimpsest.streaming.incremental import fresh_path

RUN_SELECT = "SELECT episode_uuid, session_id, run_id, ts AS run_at, augmented_query, agent_response, llm_saved_memory, n_calls FROM fx_runs"


@register("explode_runs", RUN_SELECT)
def _(s):
    return runs.explode_runs(s.query_episodes()).select(
        "episode_uuid", "session_id", "run_id", "run_at", "augmented_query", "agent_response", "llm_saved_memory",
        F.size("tools_used").cast("long").alias("n_calls"))


CALLS = """SELECT episode_uuid, session_id, run_id, tool_name, success, duration_ms, ts AS called_at, error, parent_tool_name,
           output AS output_summary, CASE WHEN k % 11 <> 0 THEN k::VARCHAR END AS k FROM fx_tool_calls"""


@register("explode_tools", CALLS)
def _(s):
    return runs.explode_tools(s.query_episodes()).select(
        "episode_uuid", "session_id", "run_id", "tool_name", "success", "duration_ms", "called_at", "error",
        "parent_tool_name", "output_summary", F.col("input_params")["k"].alias("k"))


@register("tool_stats", """
    SELECT tool_name, count(*) AS usage_count, count(*) FILTER (success) AS success_count, count(*) FILTER (NOT success) AS failure_count,
           sum(duration_ms)::BIGINT AS total_duration_ms, round(count(*) FILTER (success) / count(*), 6) AS success_rate,
           round(sum(duration_ms) / count(*), 6) AS avg_duration_ms, array_to_string(any_value(errs), ',') AS recent_errors
    FROM fx_tool_calls JOIN (SELECT tool_name, list(error ORDER BY rn) AS errs FROM (
        SELECT c.tool_name, c.error, row_number() OVER (PARTITION BY c.tool_name ORDER BY q.created_at, c.episode_uuid, c.session_id, c.run_id, c.ts, c.event_id) AS rn
        FROM fx_tool_calls c JOIN fx_query_episodes q ON q.uuid = c.episode_uuid WHERE NOT c.success) WHERE rn <= 5 GROUP BY 1) USING (tool_name) GROUP BY 1""")
def _(s):
    stats = runs.tool_stats(runs.explode_tools(stage(s.query_episodes())))
    return stats.withColumns({
        "success_rate": F.round("success_rate", 6), "avg_duration_ms": F.round("avg_duration_ms", 6),
        "recent_errors": F.array_join(F.transform("recent_errors", lambda e: e["error"]), ",")})


@register("tool_preferences", "SELECT user_id, tool_name, usage_count, success_rate, last_used, rank FROM (" + top("""
    SELECT user_id, tool_name, count(*) AS usage_count, round(count(*) FILTER (success) / count(*), 6) AS success_rate, max(ts) AS last_used
    FROM fx_tool_calls GROUP BY 1, 2""", 3, "usage_count DESC, tool_name", "user_id") + ")")
def _(s):
    return runs.tool_preferences(runs.explode_tools(stage(s.query_episodes())), limit=3).withColumn("success_rate", F.round("success_rate", 6))


@register("run_tool_summary", """
    SELECT episode_uuid, session_id, run_id, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed
    FROM fx_tool_calls GROUP BY 1, 2, 3""")
def _(s):
    return runs.run_tool_summary(s.query_episodes())


@register("latest_run_per_session", """
    SELECT episode_uuid, session_id, max(run_id) AS run_id, arg_max(ts, run_id) AS run_at FROM fx_runs GROUP BY 1, 2""")
def _(s):
    return runs.latest_run_per_session(s.query_episodes())


@register("latest_session", """
    SELECT query_id, session_id, episode_uuid, session_at FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY session_at DESC, rank, session_id) AS rn FROM (
        SELECT h.query_id, h.rank, r.session_id, r.episode_uuid, max(r.ts) AS session_at FROM h JOIN fx_runs r ON r.episode_uuid = h.uuid GROUP BY ALL)) WHERE rn = 1""",
          extra="h AS (SELECT user_key AS query_id, uuid, (row_number() OVER (PARTITION BY user_key ORDER BY created_at, uuid))::INTEGER AS rank FROM fx_query_episodes)")
def _(s):
    eps = stage(s.query_episodes())
    owner = F.regexp_extract("uuid", r"^q(\d+)_", 1).cast("long")
    from pyspark.sql import Window as W
    hits = eps.select(owner.alias("query_id"), "uuid", "created_at").withColumn(
        "rank", F.row_number().over(W.partitionBy("query_id").orderBy("created_at", "uuid"))).drop("created_at")
    return runs.latest_session(eps, hits).drop("runs")


@register("runs_by_time", "SELECT episode_uuid, run_id, ts AS run_at FROM fx_runs ORDER BY ts DESC, episode_uuid, run_id")
def _(s):
    return runs.runs_by_time(s.query_episodes()).select("episode_uuid", "run_id", "run_at")


@register("augmented_queries", """
    SELECT q.uuid, q.user_id, q.created_at, r.n_runs FROM fx_query_episodes q JOIN (
      SELECT episode_uuid, count(*) AS n_runs FROM fx_runs WHERE augmented_query <> question GROUP BY 1) r ON r.episode_uuid = q.uuid
    WHERE q.user_id = 'u_de' ORDER BY q.created_at DESC, q.uuid LIMIT 100 OFFSET 20""")
def _(s):
    out = runs.augmented_queries(s.query_episodes(), user_id="u_de", only_augmented=True, limit=100, offset=20)
    return out.select("uuid", "user_id", "created_at", F.size("runs").cast("long").alias("n_runs"))


SIMILAR = """
    sq_hit AS (SELECT q.query_id, e.uuid, e.created_at, CASE WHEN e.content = q.text THEN 1.0
                 ELSE round(list_cosine_similarity(e.content_embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) END AS score
               FROM fx_query_episodes e JOIN fx_queries q ON q.user_id IS NULL OR q.user_id = e.user_id),
    sq AS (""" + top("SELECT * FROM sq_hit WHERE score >= 0.3", 5) + ")"


@register("similar_queries", "SELECT query_id, uuid, score, rank FROM sq", extra=SIMILAR)
def _(s):
    return augment.similar_queries(stage(s.query_episodes()), s.queries()).select("query_id", "uuid", "score", "rank")


_ASKED_DOC = """SELECT q.*, q.content || coalesce(' ' || m, '') AS txt FROM fx_query_episodes q LEFT JOIN (
    SELECT episode_uuid, string_agg(llm_saved_memory, ' ' ORDER BY session_id, run_id) FILTER (llm_saved_memory <> '') AS m FROM fx_runs GROUP BY 1) ON episode_uuid = q.uuid"""


@register("similar_queries_bm25", "SELECT query_id, uuid, score, rank FROM k WHERE score >= 0.3", extra=bm25_ctes("k", _ASKED_DOC, limit=5))
def _(s):
    """Without vectors: past queries and what was remembered in their runs, by keywords."""
    g = search.Graph(stage(s.query_episodes()), None, None, None)
    return augment.similar_by_search(g, s.queries(), strategy="bm25").select("query_id", "uuid", "score", "rank")


@register("similar_queries_semantic", "SELECT query_id, uuid, score, rank FROM k", extra="k AS (" + sim_sql("SELECT * FROM fx_query_episodes", "content_embedding", 5, 0.3) + ")")
def _(s):
    """Through the search that answers all strategies."""
    edges = stage(s.plain_edges().drop("episodes", "mentions"))
    g = search.Graph(stage(s.query_episodes()), s.entities(), edges, s.mentions(), fact_vectors=s.fact_vectors(edges))
    return augment.similar_by_search(g, s.queries(), strategy="semantic").select("query_id", "uuid", "score", "rank")


@register("augment_context", """
    SELECT b.query_id, b.uuid, '[' || coalesce(a.agent_response, 'No previous response recorded') || '] ' || l.session_id || ' | ' || t.summary || ' | ' || q.text AS context
    FROM (SELECT query_id, uuid FROM sq WHERE rank = 1) b JOIN fx_queries q USING (query_id)
    LEFT JOIN (SELECT episode_uuid, first(agent_response ORDER BY session_id, run_id) AS agent_response FROM fx_runs WHERE agent_response <> '' GROUP BY 1) a ON a.episode_uuid = b.uuid
    JOIN (SELECT episode_uuid, string_agg(tool_name || CASE WHEN k % 11 <> 0 THEN ' with [k=' || k || ']' ELSE '' END || ' -> ' ||
           CASE WHEN output IN ('', 'None') THEN '[]' ELSE output END, ', ' ORDER BY session_id, run_id, ts, event_id) AS summary FROM fx_tool_calls GROUP BY 1) t ON t.episode_uuid = b.uuid
    JOIN (SELECT query_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY session_at DESC, rank, session_id) AS rn FROM (
            SELECT sq.query_id, sq.rank, r.session_id, max(r.ts) AS session_at FROM sq JOIN fx_runs r ON r.episode_uuid = sq.uuid GROUP BY ALL)) WHERE rn = 1) l ON l.query_id = b.query_id""",
          extra=SIMILAR)
def _(s):
    out = augment.augment_context(stage(s.query_episodes()), s.queries(),
                                  template="[{agent_response}] {last_session} | {tool_summary} | {query_text}")
    # The session block is checked by its first line; its layout is covered by the unit tests.
    short = F.regexp_replace("context", r"(?s)\] Session ID: ([^\n]+)\n\nRuns in this session.*?ms\) \| ", "] $1 | ")
    return out.select("query_id", "uuid", short.alias("context"))


@register("apply_user_override", """
    SELECT event_id, coalesce(o.user_id, c.user_id) AS user_id FROM fx_tool_calls c
    LEFT JOIN (SELECT 't' || c_custkey || '_2024-01-02' AS session_id, 'o_' || c_nationkey AS user_id FROM customer) o USING (session_id)""")
def _(s):
    o = s.table("customer").select(F.concat(F.lit("t"), "c_custkey", F.lit("_2024-01-02")).alias("session_id"),
                                   F.concat(F.lit("o_"), "c_nationkey").alias("user_id"))
    twice = o.unionByName(o.withColumn("user_id", F.lit("a")))  # an override that loses
    return runs.apply_user_override(s.tool_calls(), twice).select("event_id", "user_id")


def tool_log(s):
    calls = s.tool_calls()
    note = F.concat(F.lit("mail x"), F.col("k"), F.lit("@example.com"))
    return calls.select(
        F.col("event_id").alias("call_id"), "episode_uuid", "session_id", "tool_name", "parent_tool_name", "success", "duration_ms",
        F.col("ts").alias("called_at"), F.create_map(F.lit("api_key"), F.col("k").cast("string"), F.lit("note"), note).alias("input_params"),
        F.col("output"), "error")


@register("track_tool_executions", """
    SELECT event_id AS call_id, session_id, coalesce(parent_tool_name || '.', '') || tool_name AS tool_name, '[REDACTED]' AS api_key,
           'mail [EMAIL]' AS note, output AS output_summary, error FROM fx_tool_calls""")
def _(s):
    out = runs.track_tool_executions(tool_log(s))
    return out.select("call_id", "session_id", F.col("call.tool_name").alias("tool_name"), F.col("call.input_params")["api_key"].alias("api_key"),
                      F.col("call.input_params")["note"].alias("note"), F.col("call.output_summary").alias("output_summary"), F.col("call.error").alias("error"))


def incoming_runs(s):
    """Each session asks twice more; sessions of odd users are new."""
    calls = s.tool_calls().groupBy("session_id", "user_key", "user_id").agg(F.max("ts").alias("run_at"))
    session = F.when(F.col("user_key") % 2 == 1, F.concat(F.lit("new_"), "session_id")).otherwise(F.col("session_id"))
    calls = calls.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2)))).withColumn("run_at", F.col("run_at") + F.make_dt_interval(secs=F.col("n").cast("decimal(18,6)")))
    run = F.struct(F.concat(F.lit("again_"), "n", F.lit("_"), "session_id").alias("run_id"), F.col("user_id"),
                   F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("again").alias("query"))
    return calls.select(session.alias("session_id"), "user_id", F.concat(F.lit("again "), "n").alias("content"), "run_at", run.alias("run"))


@register("prepare_query_runs", """
    SELECT CASE WHEN user_key % 2 = 1 THEN 'new_' || session_id ELSE session_id END AS session_id, action,
           CASE WHEN user_key % 2 = 1 THEN 'q' || sha256(user_id || '|new_' || session_id || '|again 1') ELSE ep END AS episode_uuid,
           CASE WHEN action = 'append' THEN 'again_' || n || '_' || session_id END AS run_id
    FROM (SELECT session_id, user_key, user_id, min({'t': q.created_at, 'u': q.uuid}).u AS ep
          FROM (SELECT DISTINCT session_id, user_key, user_id, episode_uuid FROM fx_runs) r JOIN (SELECT uuid, created_at FROM fx_query_episodes) q ON q.uuid = r.episode_uuid
          GROUP BY 1, 2, 3),
         (SELECT 'append' AS action, unnest([1, 2]) AS n UNION ALL SELECT 'create', 0) WHERE action = 'append' OR user_key % 2 = 1""")
def _(s):
    to_append, to_create = runs.prepare_query_runs(stage(s.query_episodes()), incoming_runs(s))
    a = to_append.select("session_id", F.lit("append").alias("action"), "episode_uuid", F.col("run.run_id").alias("run_id"))
    return a.unionByName(to_create.select("session_id", F.lit("create").alias("action"), F.col("uuid").alias("episode_uuid"), F.lit(None).cast("string").alias("run_id")))


# ---- metadata updates ---------------------------------------------------------------------------

def flat_runs(episodes):
    return runs.explode_runs(episodes).select(
        "episode_uuid", "session_id", "run_id", "agent_response", F.size("tools_used").cast("long").alias("n_calls"))


@register("set_metadata", "SELECT uuid, CASE WHEN user_id = 'u_en' THEN '{\"tags\":[\"x\"]}' ELSE metadata END AS metadata FROM fx_episodes")
def _(s):
    eps = s.episodes().select("uuid", "user_id", "metadata")
    ups = eps.filter("user_id = 'u_en'").select("uuid", F.explode(F.array(F.lit('{"tags":["x"]}'), F.lit('{"tags":["a"]}'))).alias("metadata"))
    return metadata.set_metadata(eps, ups).select("uuid", "metadata")


@register("add_session_key", """
    SELECT uuid, (SELECT count(DISTINCT session_id) FROM fx_runs r WHERE r.episode_uuid = q.uuid) + 1 AS n_sessions, 'Run,' || user_id AS tags FROM fx_query_episodes q""")
def _(s):
    eps = stage(s.query_episodes())
    first = runs.explode_runs(eps).groupBy("episode_uuid").agg(F.min("session_id").alias("session_id"))
    links = first.unionByName(first.withColumn("session_id", F.concat(F.lit("extra_"), "episode_uuid")))
    out = metadata.add_session_key(eps, links)
    m = F.from_json("metadata", "sessions map<string,string>, tags array<string>")
    return out.select("uuid", F.size(m["sessions"]).cast("long").alias("n_sessions"), F.array_join(m["tags"], ",").alias("tags"))


@register("append_run", """
    SELECT episode_uuid, session_id, run_id, n_calls FROM fx_runs UNION ALL
    SELECT DISTINCT episode_uuid, session_id, 'again_' || session_id, 0 FROM fx_runs UNION ALL
    SELECT DISTINCT episode_uuid, 'fresh', 'fresh_run', 0 FROM fx_runs""")
def _(s):
    eps = stage(s.query_episodes())
    have = stage(runs.explode_runs(eps).select("episode_uuid", "session_id", "run_id"))
    last = have.groupBy("episode_uuid", "session_id").agg(F.max("run_id").alias("run_id"))
    again = have.select("episode_uuid", "session_id", F.concat(F.lit("again_"), "session_id").alias("run_id")).distinct()
    fresh = have.select("episode_uuid", F.lit("fresh").alias("session_id"), F.lit("fresh_run").alias("run_id")).distinct()
    # The last run repeated (dropped), a new run twice (kept once), and a run of a new session.
    ups = (last.withColumn("n", F.lit(1)).unionByName(again.withColumn("n", F.lit(2)))
           .unionByName(again.withColumn("n", F.lit(3))).unionByName(fresh.withColumn("n", F.lit(1))))
    run = F.from_json(F.to_json(F.struct("run_id")), "run_id string, user_id string, timestamp string, query string, augmented_query string, "
                      "agent_response string, tools_used array<struct<tool_name:string,success:boolean,duration_ms:bigint,timestamp:string,"
                      "input_params:map<string,string>,output_summary:string,error:string,parent_tool_name:string>>, llm_saved_memory string")
    ups = ups.select("episode_uuid", "session_id", F.timestamp_seconds("n").alias("run_at"), run.alias("run"))
    out = metadata.append_run(eps, ups)
    flat = flat_runs(out)
    return flat.select("episode_uuid", "session_id", "run_id", F.greatest(F.coalesce("n_calls", F.lit(0)), F.lit(0)).alias("n_calls"))


@register("append_tool_execution", """
    SELECT episode_uuid, session_id, run_id, n_calls + CASE WHEN run_id = max(run_id) OVER (PARTITION BY episode_uuid, session_id)
           THEN sum(n_calls) OVER (PARTITION BY episode_uuid, session_id)::BIGINT ELSE 0 END AS n_calls FROM fx_runs""")
def _(s):
    calls = runs.track_tool_executions(tool_log(s))
    strays = calls.withColumn("session_id", F.lit("no such session"))
    return flat_runs(metadata.append_tool_execution(s.query_episodes(), calls.unionByName(strays))).drop("agent_response")


@register("run_log_tool_execution", """
    SELECT episode_uuid, session_id, run_id, n_calls + CASE WHEN run_id = max(run_id) OVER (PARTITION BY episode_uuid, session_id)
           THEN sum(n_calls) OVER (PARTITION BY episode_uuid, session_id)::BIGINT ELSE 0 END AS n_calls,
           CASE WHEN run_id = max(run_id) OVER (PARTITION BY episode_uuid, session_id) THEN 'all done' ELSE 'open' END AS agent_response FROM fx_runs""")
def _(s):
    """Calls and answers as rows of a log: no document is parsed or rewritten."""
    said = s.tool_calls()
    log = RunLog.create(s.spark, fresh_path(s.spark, "runs"))
    began = said.groupBy("episode_uuid", "session_id", "run_id").agg(F.min("ts").alias("run_at")).withColumn("agent_response", F.lit("open"))
    log = log.append(runs=began, calls=said.select("episode_uuid", "session_id", F.col("ts").alias("called_at"), F.col("run_id").alias("of")))
    calls = said.select("episode_uuid", "session_id", F.col("ts").alias("called_at"), F.col("event_id").cast("string").alias("call_id"))
    strays = calls.withColumn("session_id", F.lit("no such session"))
    parts = began.select("episode_uuid", "session_id").distinct().select("*", F.posexplode(F.array(F.lit("all"), F.lit("done"))).alias("part_no", "part"))
    log = log.append(calls=calls.unionByName(strays), answers=parts)
    return RunLog.load(s.spark, log.root).flat().select("episode_uuid", "session_id", "run_id", "n_calls", "agent_response")


@register("set_agent_response", """
    SELECT episode_uuid, session_id, run_id, CASE WHEN run_id = max(run_id) OVER (PARTITION BY episode_uuid, session_id)
           THEN 'all done' ELSE agent_response END AS agent_response FROM fx_runs""")
def _(s):
    eps = stage(s.query_episodes())
    parts = runs.explode_runs(eps).select("episode_uuid", "session_id").distinct().withColumn(
        "p", F.explode(F.array(F.struct(F.lit(2).alias("part_no"), F.lit("done").alias("part")), F.struct(F.lit(1).alias("part_no"), F.lit("all").alias("part")))))
    out = metadata.set_agent_response(eps, parts.select("episode_uuid", "session_id", "p.*"))
    return flat_runs(out).drop("n_calls")


@register("append_memory", """
    SELECT episode_uuid AS uuid, string_agg('seen ' || run_id, ',' ORDER BY ts, 'seen ' || run_id) AS memories FROM fx_runs GROUP BY 1""")
def _(s):
    eps = stage(s.query_episodes())
    mem = runs.explode_runs(eps).select("episode_uuid", F.col("run_at").alias("created_at"), F.concat(F.lit("seen "), "run_id").alias("content"),
                                        "user_id", "session_id", F.lit("agent").alias("source"))
    out = metadata.append_memory(eps, mem)
    m = F.from_json("metadata", "memories array<struct<content:string>>, tags array<string>")
    return out.select("uuid", F.array_join(F.transform(m["memories"], lambda x: x["content"]), ",").alias("memories"))
