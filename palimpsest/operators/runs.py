"""Session and tool analytics over the nested run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import schema
from palimpsest.functions import privacy, values
from palimpsest.operators import filters
from palimpsest.operators.aggregates import top_per_group
from palimpsest.operators.joins import metadata_struct
from palimpsest.operators.skew import split_hot_join
from palimpsest.session import stage

MAX_ERRORS = 5  # fixed value: errors that a tool's statistics list
RUN_FIELDS = ("run_id", "query", "augmented_query", "agent_response", "llm_saved_memory")
CALL_ORDER = ("created_at", "episode_uuid", "session_pos", "run_pos", "call_pos")


def iso_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def explode_runs(episodes: DataFrame) -> DataFrame:
    """One row per run, carrying its session and its position in the metadata."""
    meta = metadata_struct(episodes).select(
        F.col("uuid").alias("episode_uuid"), "user_id", "created_at", F.col("meta.sessions").alias("sessions"))
    sessions = meta.select("episode_uuid", "user_id", "created_at",
                           F.posexplode("sessions").alias("session_pos", "session_id", "runs"))
    runs = sessions.select("episode_uuid", "user_id", "created_at", "session_pos", "session_id",
                           F.posexplode("runs").alias("run_pos", "run"))
    return runs.select("episode_uuid", "user_id", "created_at", "session_pos", "session_id", "run_pos",
                       *[F.col(f"run.{f}").alias(f) for f in RUN_FIELDS],
                       iso_timestamp(F.col("run.timestamp")).alias("run_at"), F.col("run.tools_used").alias("tools_used"))


def explode_tools(episodes: DataFrame) -> DataFrame:
    """One row per tool call; older metadata keeps its calls at the top, outside any session."""
    none = F.lit(None).cast("string")
    bare = F.struct(*[none.alias(f) for f in ("run_id", "user_id", "timestamp", "query", "augmented_query", "agent_response")],
                    F.col("meta.tools_used").alias("tools_used"), none.alias("llm_saved_memory")).cast(schema.RUN_DDL)
    sessions = F.when(F.col("meta.sessions").isNotNull(), F.map_entries("meta.sessions")).otherwise(
        F.array(F.struct(none.alias("key"), F.array(bare).alias("value"))))
    rows = metadata_struct(episodes).select(F.col("uuid").alias("episode_uuid"), "user_id", "created_at",
                                            F.posexplode(sessions).alias("session_pos", "session"))
    rows = rows.select("episode_uuid", "user_id", "created_at", "session_pos", F.col("session.key").alias("session_id"),
                       F.posexplode("session.value").alias("run_pos", "run"))
    base = ["episode_uuid", "user_id", "created_at", "session_pos", "session_id", "run_pos", "run_id"]
    rows = rows.select(*base[:-1], F.col("run.run_id").alias("run_id"), F.posexplode("run.tools_used").alias("call_pos", "call"))
    fields = [F.col(f"call.{f}").alias(f) for f in (
        "tool_name", "success", "duration_ms", "input_params", "output_summary", "error", "parent_tool_name")]
    return rows.select(*base, "call_pos", *fields, iso_timestamp(F.col("call.timestamp")).alias("called_at"))


def tool_stats(calls: DataFrame, *, min_executions: int = 1, max_errors: int = MAX_ERRORS) -> DataFrame:
    """Usage, failures, success rate and mean duration per tool, and its first few errors.

    Errors are limited per tool inside every task before the shuffle; counts combine likewise.  Both read the calls
    from a written table, so that nested metadata are parsed once.
    """
    calls = stage(calls.select("tool_name", "success", "duration_ms", "error", "called_at", *CALL_ORDER))
    stats = calls.groupBy("tool_name").agg(
        F.count("*").alias("usage_count"), F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_duration_ms"))
    errors = top_per_group(calls.filter(~F.col("success")), ["tool_name"], list(CALL_ORDER), max_errors)
    listed = errors.groupBy("tool_name").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.coalesce("error", F.lit("")).alias("error"), "called_at"))).alias("recent_errors"))
    enough = F.col("usage_count") >= min_executions
    return stats.join(listed, "tool_name", "left").select(
        "tool_name", "usage_count", "success_count", "failure_count", "total_duration_ms",
        F.when(enough, F.col("success_count") / F.col("usage_count")).otherwise(F.lit(0.0)).alias("success_rate"),
        F.when(enough, F.col("total_duration_ms") / F.col("usage_count")).otherwise(F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.transform("recent_errors", lambda e: F.struct(e["error"], e["called_at"])),
                   F.array().cast("array<struct<error:string,called_at:timestamp>>")).alias("recent_errors"))


def tool_preferences(calls: DataFrame, *, limit: int = 10) -> DataFrame:
    """Most used tools of each user with success rate and time of last use."""
    used = calls.groupBy("user_id", "tool_name").agg(
        F.count("*").alias("usage_count"), F.count_if("success").alias("ok"), F.max("called_at").alias("last_used"))
    used = used.withColumn("success_rate", F.col("ok") / F.col("usage_count")).drop("ok")
    return top_per_group(used, ["user_id"], [F.desc("usage_count"), "tool_name"], limit)


def run_tool_summary(episodes: DataFrame) -> DataFrame:
    """Successes and failures of each run, counted inside its row."""
    runs = explode_runs(episodes)
    return runs.select(
        "episode_uuid", "session_id", "run_id",
        F.size(F.filter("tools_used", lambda t: t["success"])).cast("long").alias("succeeded"),
        F.size(F.filter("tools_used", lambda t: ~t["success"])).cast("long").alias("failed"))


def latest_run_per_session(episodes: DataFrame) -> DataFrame:
    sessions = metadata_struct(episodes).select(
        F.col("uuid").alias("episode_uuid"), F.explode("meta.sessions").alias("session_id", "runs"))
    last = F.try_element_at("runs", F.lit(-1))
    return sessions.select("episode_uuid", "session_id", last["run_id"].alias("run_id"),
                           iso_timestamp(last["timestamp"]).alias("run_at")).filter("run_id IS NOT NULL")


def latest_session(episodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query the session with the latest run among its hit episodes ``query_id, uuid, rank``.

    Equal times go to the earlier hit, then to the earlier session of its metadata.
    """
    sessions = metadata_struct(episodes.join(hits.select("uuid"), "uuid", "left_semi")).select(
        "uuid", F.posexplode("meta.sessions").alias("session_pos", "session_id", "runs"))
    newest = F.array_max(F.transform("runs", lambda r: iso_timestamp(r["timestamp"])))
    rows = sessions.withColumn("session_at", newest).filter("session_at IS NOT NULL").join(hits, "uuid")
    order = F.struct((-F.unix_micros("session_at")).alias("t"), "rank", "session_pos")
    best = F.min_by(F.struct("session_id", F.col("uuid").alias("episode_uuid"), "session_at", "runs"), order)
    return rows.groupBy("query_id").agg(best.alias("s")).select("query_id", "s.*")


def runs_by_time(episodes: DataFrame) -> DataFrame:
    return explode_runs(episodes).orderBy(F.desc("run_at"), "episode_uuid", "run_id")


def augmented_queries(episodes: DataFrame, *, user_id: str | None = None, only_augmented: bool = False,
                      limit: int = 50, offset: int = 0) -> DataFrame:
    """Message episodes with their flattened runs: filtered first, then paged."""
    rows = filters.by_user(filters.by_source_type(episodes, "message"), user_id)
    rows = metadata_struct(rows).withColumn("runs", F.flatten(F.map_values("meta.sessions"))).filter("runs IS NOT NULL")
    if only_augmented:
        rows = filters.only_augmented(rows)
    return rows.select("uuid", "content", "user_id", "created_at", "runs").orderBy(
        F.desc("created_at"), "uuid").offset(offset).limit(limit)


def apply_user_override(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides(session_id, user_id)`` win over the row's own user.

    Of several overrides of a session the greatest user counts, or the latest if there is an ``updated_at``.
    """
    pick = F.max_by("user_id", F.struct("updated_at", "user_id")) if "updated_at" in overrides.columns else F.max("user_id")
    o = overrides.groupBy("session_id").agg(pick.alias("_override"))
    return df.join(o, "session_id", "left").withColumn("user_id", F.coalesce("_override", "user_id")).drop("_override")


def track_tool_executions(log: DataFrame, *, sample_rate: float = 1.0, sanitize: bool = True,
                          max_output_chars: int = 1000, summarize: bool = True) -> DataFrame:
    """Raw call log to storable calls: sampled, redacted, shortened, with dotted names.

    log: ``call_id, episode_uuid, session_id, tool_name, parent_tool_name, success, duration_ms,
    called_at, input_params map, output, error``.
    """
    clean = privacy.pii_mask if sanitize else (lambda c: c)
    kept = log.filter(values.keep_sample(F.col("call_id"), sample_rate)) if sample_rate < 1 else log
    return kept.select(
        "call_id", "episode_uuid", "session_id", "called_at",
        F.struct(
            values.dotted_tool_name(F.col("tool_name"), F.col("parent_tool_name")).alias("tool_name"), "success",
            F.col("duration_ms").cast("bigint").alias("duration_ms"),
            F.date_format("called_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            privacy.redact_params(F.col("input_params"), sanitize).alias("input_params"),
            privacy.summarize_output(F.col("output"), max_output_chars, summarize, sanitize).alias("output_summary"),
            clean(F.col("error")).alias("error"), F.col("parent_tool_name").alias("parent_tool_name"),
        ).cast(schema.TOOL_CALL_DDL).alias("call"))


def prepare_query_runs(episodes: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All incoming runs ``session_id, user_id, content, run_at, run`` with the ``episode_uuid`` they belong to, for
    ``append_run``, and one row per session without an episode that must be created first.

    A new session's episode is that of its earliest run; its id is made from user, session and content.
    """
    known = filters.lookup_by_session(episodes, runs.select("session_id").distinct()).select(
        "session_id", F.col("uuid").alias("episode_uuid"))
    linked = stage(split_hot_join(runs, known, ["session_id"], "left"))
    first = F.min_by(F.struct("user_id", "content", "run_at"), F.struct("run_at", F.col("run.run_id")))
    to_create = linked.filter("episode_uuid IS NULL").groupBy("session_id").agg(first.alias("f")).select(
        "session_id", "f.user_id", "f.content", F.col("f.run_at").alias("created_at"),
        F.concat(F.lit("q"), F.sha2(F.concat_ws("|", F.col("f.user_id"), "session_id", F.col("f.content")), 256)).alias("uuid"))
    fresh = to_create.select("session_id", F.col("uuid").alias("_new"))
    to_append = linked.join(fresh, "session_id", "left").withColumn("episode_uuid", F.coalesce("episode_uuid", "_new")).drop("_new")
    return to_append, to_create
