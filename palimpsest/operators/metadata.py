"""Updates of the nested run metadata.

The stored document is changed by key: keys this library does not know are carried over as they
are, so tags, memories and free keys survive every write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import schema

_RUNS = f"array<{schema.RUN_DDL}>"
_SESSIONS = f"map<string,{_RUNS}>"
_MEMORIES = f"array<{schema.MEMORY_DDL}>"


def replace_key(metadata: Column, key: str, value: Column) -> Column:
    """The document with ``key`` set to ``value``; a null value leaves it unchanged."""
    doc = F.coalesce(F.from_json(metadata, "map<string,variant>"), F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<variant>")))
    rest = F.map_filter(doc, lambda k, v: k != key)

    def changed(v: Column) -> Column:
        return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(F.to_json(v)))))

    # a lambda over one element binds the value, which is costly and would be made once more to see whether it is null
    return F.element_at(F.transform(F.array(value), lambda v: F.when(v.isNull(), metadata).otherwise(changed(v))), 1)


def sessions_of(metadata: Column) -> Column:
    parsed = F.from_json(metadata, f"sessions {_SESSIONS}, tags array<string>")["sessions"]
    return F.coalesce(parsed, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{_RUNS}>")))


def set_metadata(episodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace whole documents: ``updates(uuid, metadata)``.

    Of several updates of an episode the greatest document counts, or the latest if there is an ``updated_at``.
    """
    pick = F.max_by("metadata", F.struct("updated_at", "metadata")) if "updated_at" in updates.columns else F.max("metadata")
    u = updates.groupBy("uuid").agg(pick.alias("_m"))
    return episodes.join(u, "uuid", "left").withColumn("metadata", F.coalesce("_m", "metadata")).drop("_m")


def by_session(updates: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Updates of one batch as one map per episode: session -> values in order."""
    keyed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(value).alias("v"))), _by(order)),
                        lambda x: x["v"][value])
    per_session = updates.groupBy("episode_uuid", "session_id").agg(keyed.alias("items"))
    return per_session.groupBy(F.col("episode_uuid").alias("uuid")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("session_id", "items")), _by(["session_id"]))).alias("_u"))


def _by(order: list[str]):
    """Comparator on some fields, so that values without an order (maps) may ride along."""
    def compare(a: Column, b: Column) -> Column:
        x, y = F.struct(*[a[o] for o in order]), F.struct(*[b[o] for o in order])
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return compare


def _apply(episodes: DataFrame, updates: DataFrame, change) -> DataFrame:
    """Rewrite ``sessions`` where there are updates."""
    old = sessions_of(F.col("metadata"))
    new = F.when(F.col("_u").isNotNull(), change(old, F.col("_u")))
    return episodes.join(updates, "uuid", "left").withColumn("metadata", replace_key(F.col("metadata"), "sessions", new)).drop("_u")


def with_session(metadata: Column, session: Column) -> Column:
    """The document with an empty run list for ``session``, unless it has the session or ``session`` is null."""
    old = sessions_of(metadata)
    new = F.map_concat(old, F.map_from_arrays(F.array(session), F.array(F.array().cast(_RUNS))))
    known = session.isNull() | F.coalesce(F.map_contains_key(old, F.coalesce(session, F.lit(""))), F.lit(False))
    return replace_key(metadata, "sessions", F.when(~known, new))


def add_session_key(episodes: DataFrame, links: DataFrame) -> DataFrame:
    """``links(episode_uuid, session_id)``: an empty run list for sessions not yet in the document."""
    new = links.groupBy(F.col("episode_uuid").alias("uuid")).agg(F.array_sort(F.collect_set("session_id")).alias("_u"))

    def change(old: Column, ids: Column) -> Column:
        missing = F.array_except(ids, F.map_keys(old))
        return F.map_concat(old, F.map_from_entries(F.transform(
            missing, lambda k: F.struct(k.alias("k"), F.array().cast(_RUNS).alias("v")))))

    return _apply(episodes, new, change)


def append_run(episodes: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs(episode_uuid, session_id, run_at, run)`` in time order.

    A run is appended if its session is new or its id differs from the session's last run; a
    session that is present but empty stays empty.
    """
    ups = by_session(runs.withColumn("run_id", F.col("run.run_id")), "run", ["run_at", "run_id"])

    def fold(start: Column, more: Column) -> Column:
        return F.aggregate(more, start, lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["run_id"] == r["run_id"]), acc
        ).otherwise(F.concat(acc, F.array(r))))

    def merge(_, old: Column, new: Column) -> Column:
        return (F.when(new.isNull(), old).when(old.isNull(), fold(F.array().cast(_RUNS), new))
                .when(F.size(old) == 0, old).otherwise(fold(old, new)))

    return _apply(episodes, ups, lambda old, u: F.map_zip_with(old, u.cast(_SESSIONS), merge))


def _on_latest_run(old: Column, updates: Column, change) -> Column:
    """Change the last run of every session that has a run and an update."""
    def one(k: Column, runs: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        new = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(change(last, F.try_element_at(updates, k))))
        return F.when((F.size(runs) == 0) | F.try_element_at(updates, k).isNull(), runs).otherwise(new)
    return F.transform_values(old, one)


def append_tool_execution(episodes: DataFrame, calls: DataFrame) -> DataFrame:
    """``calls(episode_uuid, session_id, called_at, call_id, call)`` join the latest run of their session."""
    ups = by_session(calls, "call", ["called_at", "call_id"])
    none = F.array().cast(f"array<{schema.TOOL_CALL_DDL}>")
    return _apply(episodes, ups, lambda old, u: _on_latest_run(
        old, u, lambda run, new: run.withField("tools_used", F.concat(F.coalesce(run["tools_used"], none), new))))


def set_agent_response(episodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts(episode_uuid, session_id, part_no, part)``: joined by spaces onto the latest run."""
    ups = by_session(parts, "part", ["part_no"])
    return _apply(episodes, ups, lambda old, u: _on_latest_run(
        old, u, lambda run, new: run.withField("agent_response", F.array_join(new, " "))))


def append_memory(episodes: DataFrame, memories: DataFrame) -> DataFrame:
    """``memories(episode_uuid, created_at, content, user_id, session_id, source)`` onto ``memories``."""
    value = F.struct("content", "user_id", "session_id", "source").cast(schema.MEMORY_DDL)
    ups = memories.groupBy(F.col("episode_uuid").alias("uuid")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("created_at", value.alias("m")))), lambda x: x["m"]).alias("_u"))
    old = F.coalesce(F.from_json("metadata", f"memories {_MEMORIES}, tags array<string>")["memories"], F.array().cast(_MEMORIES))
    new = F.when(F.col("_u").isNotNull(), F.concat(old, F.col("_u")))
    return episodes.join(ups, "uuid", "left").withColumn("metadata", replace_key(F.col("metadata"), "memories", new)).drop("_u")
