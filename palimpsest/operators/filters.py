"""Predicates and lookups.  Each is one ``filter`` or one semi join, so it reaches the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import schema


def _ts(t) -> Column:
    return t if isinstance(t, Column) else F.lit(t).cast("timestamp")


def by_user(df: DataFrame, user_id: str | None, column: str = "user_id") -> DataFrame:
    """``None`` and the empty string mean every user."""
    return df.filter(F.col(column) == user_id) if user_id else df


def by_kind(df: DataFrame, kinds: Iterable[str] | None) -> DataFrame:
    wanted = [k.lower() for k in kinds or ()]
    return df.filter(F.lower("kind").isin(wanted)) if wanted else df


def after(df: DataFrame, cutoff, column: str = "created_at") -> DataFrame:
    return df.filter(F.col(column) > _ts(cutoff))


def in_date_range(df: DataFrame, start=None, end=None, column: str = "created_at") -> DataFrame:
    if start is not None:
        df = df.filter(F.col(column) >= _ts(start))
    return df.filter(F.col(column) <= _ts(end)) if end is not None else df


def content_contains(df: DataFrame, needle: str) -> DataFrame:
    return df.filter(F.contains("content", F.lit(needle)))


def entity_text_contains(df: DataFrame, needle: str) -> DataFrame:
    low = F.lit(needle.lower())
    return df.filter(F.contains(F.lower("name"), low) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), low))


def tags_of(metadata: Column) -> Column:
    """Lower-cased tag set; parses only the ``tags`` field."""
    tags = F.from_json(metadata, schema.TAGS_ONLY)["tags"]
    clean = F.filter(tags, lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_distinct(F.transform(clean, F.lower)), F.array().cast("array<string>"))


def tag_text_contains(df: DataFrame, needle: str) -> DataFrame:
    return df.filter(F.exists(tags_of(F.col("metadata")), lambda t: F.contains(t, F.lit(needle.lower()))))


def by_tags(df: DataFrame, tags: Iterable[str] | None, mode: str = "any") -> DataFrame:
    wanted = sorted({t.lower() for t in tags or ()})
    if not wanted:
        return df
    have, want = tags_of(F.col("metadata")), F.array(*[F.lit(t) for t in wanted])
    if mode == "all":
        return df.filter(F.size(F.array_except(want, have)) == 0)
    if mode != "any":
        raise ValueError(f"unknown tag match mode {mode!r}")
    return df.filter(F.arrays_overlap(have, want))


def active_edges(edges: DataFrame, reference_time) -> DataFrame:
    return edges.filter(F.col("expired_at").isNull() | (F.col("expired_at") > _ts(reference_time)))


def facts_as_of(edges: DataFrame, *, valid_time, system_time) -> DataFrame:
    """Facts that held at ``valid_time`` as far as was recorded at ``system_time``."""
    v, s = _ts(valid_time), _ts(system_time)
    return edges.filter(
        (F.col("valid_at") <= v) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > v))
        & (F.col("created_at") <= s) & (F.col("expired_at").isNull() | (F.col("expired_at") > s)))


def by_source_type(df: DataFrame, source: str) -> DataFrame:
    if source not in schema.EPISODE_SOURCES:
        raise ValueError(f"unknown episode source {source!r}")
    return df.filter(F.col("source") == source)


def by_entity_type(df: DataFrame, entity_type: str | None) -> DataFrame:
    return df.filter(F.col("entity_type") == entity_type) if entity_type else df


def by_relation_type(df: DataFrame, name: str | None) -> DataFrame:
    return df.filter(F.col("name") == name) if name else df


def only_augmented(df: DataFrame, runs: str = "runs") -> DataFrame:
    """Keep runs whose augmented text differs from the query; drop rows left without runs."""
    kept = F.filter(runs, lambda r: F.coalesce(
        (r["augmented_query"] != "") & (r["augmented_query"] != r["query"]), F.lit(False)))
    return df.withColumn(runs, kept).filter(F.size(runs) > 0)


def min_score(df: DataFrame, threshold: float, column: str = "score") -> DataFrame:
    return df.filter(F.col(column) >= threshold)


def lookup(df: DataFrame, keys: DataFrame, column: str = "uuid") -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``: one semi join in place of point lookups."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")


def lookup_by_session(episodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """The earliest episode that carries each session key."""
    keys = F.map_keys(F.from_json("metadata", schema.SESSION_KEYS)["sessions"])
    index = episodes.filter(F.contains("metadata", F.lit('"sessions"'))).select(
        F.explode(keys).alias("session_id"), "uuid", "created_at")
    first = index.join(sessions, "session_id", "left_semi").groupBy("session_id").agg(
        F.min(F.struct("created_at", "uuid")).alias("f"))
    return first.select("session_id", "f.uuid", "f.created_at")


def validate_enums(episodes: DataFrame) -> DataFrame:
    """Fail the job on an unknown source or kind instead of storing it."""
    ok = F.col("source").isin(*schema.EPISODE_SOURCES) & F.col("kind").isin(*schema.EPISODE_KINDS)
    return episodes.filter(F.coalesce(F.assert_true(ok, F.concat(
        F.lit("unknown source or kind: "), F.col("source"), F.lit("/"), F.col("kind"))).isNull(), F.lit(True)))
