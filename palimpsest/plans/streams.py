"""Streams run to completion over the source files; the batch rule is their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import upserts
from palimpsest.operators.keyed_store import KeyedStore
from palimpsest.plans.registry import register
from palimpsest.plans.writes import DEDUP_OUT, _TOOLS, _fold_sql
from palimpsest.streaming import incremental as inc


def events(s):
    k = F.get_json_object("props", "$.k").cast("long")
    return inc.table_stream(s.spark, s.dir, "events.parquet").select(
        F.col("user_id").alias("user_key"), F.col("event_type").alias("tool_name"), (k % 5 != 0).alias("success"),
        F.round(F.col("value") * 10).cast("long").alias("duration_ms"), F.col("ts").cast("timestamp").alias("ts"))


@register("stream_dedup_exact", DEDUP_OUT, recursive=True,
          extra=_fold_sql("SELECT user_id || '|' || sha256(content) AS g, uuid AS id, created_at AS t FROM fx_doc_episodes"))
def _(s):
    docs = inc.table_stream(s.spark, s.dir, "documents.parquet").select(
        F.concat(F.lit("d"), "doc_id").alias("uuid"), F.concat(F.lit("u_"), "lang").alias("user_id"), F.col("text").alias("content"),
        s._at(F.col("doc_id") * 600).alias("created_at"))
    out = inc.fresh_path(s.spark, "dedup")
    inc.stream_dedup_exact(docs, out, out + "-cp").awaitTermination()
    return s.spark.read.parquet(out).select(F.col("uuid").alias("input_id"), "canonical_uuid", "is_new")


@register("stream_upsert", """
    SELECT coalesce(t.tool_name, u.tool_name) AS tool_name, coalesce(u.description, t.description) AS description,
           (coalesce(t.mentions, 0) + coalesce(u.mentions, 0))::BIGINT AS mentions FROM fx_tools t FULL JOIN u ON u.tool_name = t.tool_name""", extra=_TOOLS)
def _(s):
    lines = inc.table_stream(s.spark, s.dir, "lineitem.parquet").join(s.table("part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    name = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") == 6, F.concat("p_brand", F.lit(" tool"))).otherwise(F.col("p_name"))
    ups = lines.select(name.alias("tool_name"), F.concat(F.lit("seen "), "l_orderkey").alias("description"),
                       F.concat(F.lit("tool_"), name).alias("uuid"), F.col("l_orderkey").alias("created_at"))
    out = inc.fresh_path(s.spark, "tools")
    q = inc.stream_upsert(ups, s.tools(), out, out + "-cp", lambda t, u: upserts.upsert_tools(t, u)[0])
    q.awaitTermination()
    return inc.last_snapshot(s.spark, q, out).drop("uuid")


@register("stream_upsert_log", """
    SELECT coalesce(t.tool_name, u.tool_name) AS tool_name, coalesce(u.description, t.description) AS description,
           (coalesce(t.mentions, 0) + coalesce(u.mentions, 0))::BIGINT AS mentions FROM fx_tools t FULL JOIN u ON u.tool_name = t.tool_name""", extra=_TOOLS)
def _(s):
    """As stream_upsert, but a batch writes only the buckets it touches and the table is merged when it is read."""
    lines = inc.table_stream(s.spark, s.dir, "lineitem.parquet").join(s.table("part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    name = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") == 6, F.concat("p_brand", F.lit(" tool"))).otherwise(F.col("p_name"))
    ups = lines.select(name.alias("tool_name"), F.concat(F.lit("seen "), "l_orderkey").alias("description"), F.col("l_orderkey").alias("created_at"))
    root = inc.fresh_path(s.spark, "tool-log")
    KeyedStore.create(s.spark, root, s.tools().select("tool_name", "description", "mentions"), ["tool_name"], {"description": "new", "mentions": "sum"}, buckets=8)

    def one_each(batch):
        named = batch.filter(F.coalesce("tool_name", F.lit("")) != "")
        return upserts.latest(named, ["tool_name"], mentions=F.count("*"))

    inc.stream_upsert_log(ups, root, root + "-cp", one_each).awaitTermination()
    return KeyedStore.load(s.spark, root).read()


@register("stream_tool_stats", """
    SELECT date_trunc('hour', ts) AS window_start, tool_name, count(*) AS usage_count, count(*) FILTER (success) AS success_count,
           sum(duration_ms)::BIGINT AS total_duration_ms FROM fx_tool_calls GROUP BY 1, 2""")
def _(s):
    out = inc.fresh_path(s.spark, "tool-stats")
    inc.stream_tool_stats(events(s), out, out + "-cp").awaitTermination()
    return inc.latest_windows(s.spark, out)


@register("stream_sessions", """
    SELECT user_key, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM (
      SELECT *, sum(brk) OVER (PARTITION BY user_key ORDER BY ts, event_id) AS sess FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_key ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM fx_tool_calls))
    GROUP BY user_key, sess""")
def _(s):
    out = inc.fresh_path(s.spark, "sessions")
    inc.stream_sessions(events(s), out, out + "-cp").awaitTermination()
    closed = s.spark.read.parquet(out)
    calls = s.table("events").select(F.col("user_id").alias("user_key"), F.col("ts").cast("timestamp").alias("ts"))
    return closed.unionByName(inc.open_sessions(calls, closed))
