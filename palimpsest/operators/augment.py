"""Similar past queries and the context text built from them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions.text import content_key
from palimpsest.functions.values import params_text, has_params, simple_tool_summary, tool_usage_summary
from palimpsest.operators import filters, search
from palimpsest.operators.aggregates import top_per_group
from palimpsest.operators.joins import metadata_struct
from palimpsest.operators.runs import latest_session
from palimpsest.operators.vectors import similarity_topk

# Defaults, and the texts that stand for missing parts.
THRESHOLD, TOP_K = 0.3, 5
NO_RESPONSE, NO_TOOLS, NO_SESSION = "No previous response recorded", "No tools used", "No previous session found"
TEMPLATE = ("[Earlier answer]\n{agent_response}\n\n[Tools]\n{simplified_tool_summary}\n\n"
            "[Last session]\n{last_session}\n\n[Question]\n{query_text}")


def similar_queries(episodes: DataFrame, queries: DataFrame, *, threshold: float = THRESHOLD,
                    limit: int = TOP_K) -> DataFrame:
    """Past message episodes of the query's user by cosine; an identical text scores 1.

    ``query_id, uuid, score, created_at, rank``.
    """
    past = filters.by_source_type(episodes, "message")
    near = similarity_topk(past, queries, vector="content_embedding", threshold=threshold, limit=limit)
    # Copies of a text: only the newest few per user (and overall) can appear in an answer.
    keyed = past.select(content_key(F.col("content")).alias("k"), F.coalesce("user_id", F.lit("")).alias("u"), "uuid", "created_at")
    keyed = keyed.filter("u <> ''").unionByName(keyed.withColumn("u", F.lit("")))
    newest = top_per_group(keyed, ["k", "u"], [F.desc("created_at"), "uuid"], limit).drop("rank")
    asked = queries.select("query_id", content_key(F.col("text")).alias("k"), F.coalesce("user_id", F.lit("")).alias("u"))
    same = asked.join(newest, ["k", "u"]).select("query_id", "uuid", F.lit(1.0).alias("score"), "created_at")
    both = near.select("query_id", "uuid", "score", "created_at").unionByName(same)
    best = both.groupBy("query_id", "uuid", "created_at").agg(F.max("score").alias("score"))
    return top_per_group(best, ["query_id"], [F.desc("score"), F.desc("created_at"), "uuid"], limit)


def similar_by_search(g: search.Graph, queries: DataFrame, *, strategy: str = "hybrid", threshold: float = THRESHOLD, limit: int = TOP_K,
                      cfg: search.SearchConfig | None = None) -> DataFrame:
    """Past message episodes by any search strategy: ``query_id, uuid, score, created_at, rank``.

    Of the strategy's best ``limit`` episodes those that score at least ``threshold`` stay; one that was found without a score
    counts 1 if its text is the query's.  Fused scores of the hybrid strategy are at most 3 / 61, so the
    threshold has to suit the strategy: with the default only the others give answers.
    """
    cfg = search.without(cfg or search.SearchConfig(), limit=limit, threshold=threshold, min_rrf_score=0.0, apply_decay=False, apply_boost=False)
    if strategy == "bm25":
        found = search.bm25_episodes(g, queries, cfg)
    else:
        found = search.search(g, queries, cfg, strategy).filter("kind = 'episode'")
    past = filters.by_source_type(g.episodes, "message").select("uuid", content_key(F.col("content")).alias("k"), "created_at")
    asked = queries.select("query_id", content_key(F.col("text")).alias("asked"))
    both = found.select("query_id", "uuid", "score").join(past, "uuid").join(asked, "query_id")
    both = both.withColumn("score", F.when((F.col("score") == 0) & (F.col("k") == F.col("asked")), 1.0).otherwise(F.col("score")))
    return top_per_group(both.filter(F.col("score") >= threshold).select("query_id", "uuid", "score", "created_at"), ["query_id"],
                         [F.desc("score"), F.desc("created_at"), "uuid"], limit)


def _session_text(session: Column) -> Column:
    """Readable lines for the runs of one session."""
    def tool(t: Column) -> Column:
        opt = lambda cond, *parts: F.coalesce(F.when(cond, F.concat(*parts)), F.lit(""))
        return F.concat(
            F.lit("  - "), t["tool_name"],
            opt(has_params(t["input_params"]), F.lit(" with ["), params_text(t["input_params"]), F.lit("]")),
            opt(t["output_summary"] != "", F.lit(" -> "), F.substring(t["output_summary"], 1, 100)),
            opt(t["error"] != "", F.lit(" [ERROR: "), t["error"], F.lit("]")),
            F.lit(" (success: "), F.initcap(t["success"].cast("string")), F.lit(", duration: "),
            t["duration_ms"].cast("string"), F.lit("ms)"))

    def run(r: Column, i: Column) -> Column:
        return F.concat_ws(
            "\n", F.concat(F.lit("\n--- Run "), (i + 1).cast("string"), F.lit(" ---")),
            F.concat(F.lit("Timestamp: "), r["timestamp"]), F.concat(F.lit("Query: "), r["query"]),
            F.when(r["augmented_query"] != "", F.concat(F.lit("Augmented Query: "), F.substring(r["augmented_query"], 1, 200), F.lit("..."))),
            F.when(r["agent_response"] != "", F.concat(F.lit("Agent Response: "), r["agent_response"])),
            F.when(F.size(r["tools_used"]) > 0, F.concat(
                F.lit("Tools Used ("), F.size(r["tools_used"]).cast("string"), F.lit("):\n"),
                F.array_join(F.transform(r["tools_used"], tool), "\n"))))

    return F.concat(F.lit("Session ID: "), session["session_id"], F.lit("\n\nRuns in this session: "),
                    F.size(session["runs"]).cast("string"), F.lit("\n"), F.array_join(F.transform(session["runs"], run), "\n"))


def augment_context(episodes: DataFrame, queries: DataFrame, *, template: str = TEMPLATE, threshold: float = THRESHOLD,
                    limit: int = TOP_K, custom_summary: Callable[[dict], str] | None = None) -> DataFrame:
    """``query_id, context`` for queries with a usable similar past query; the best one is used.

    ``custom_summary`` maps one tool call to text; it runs as a pandas UDF on the chosen rows only.
    """
    hits = similar_queries(episodes, queries, threshold=threshold, limit=limit).select("query_id", "uuid", "rank")
    usable = metadata_struct(episodes.join(hits.select("uuid"), "uuid", "left_semi")).select("uuid", "meta")
    best = usable.join(hits, "uuid").groupBy("query_id").agg(F.min_by(F.struct("uuid", "meta"), "rank").alias("b"))
    sessions = latest_session(episodes, hits).select(
        "query_id", _session_text(F.struct("session_id", "runs")).alias("last_session"))
    runs = F.coalesce(F.flatten(F.map_values("b.meta.sessions")), F.array())
    answered = F.filter(F.transform(runs, lambda r: r["agent_response"]), lambda t: t != "")
    calls = F.flatten(F.transform(runs, lambda r: r["tools_used"]))
    parts = best.join(sessions, "query_id", "left").join(queries.select("query_id", "text"), "query_id").select(
        "query_id", F.col("b.uuid").alias("uuid"), F.col("text").alias("query_text"),
        F.coalesce(F.try_element_at(answered, F.lit(1)), F.lit(NO_RESPONSE)).alias("agent_response"),
        _or_none(tool_usage_summary(calls)).alias("tool_summary"),
        _or_none(simple_tool_summary(calls)).alias("simplified_tool_summary"),
        F.coalesce("last_session", F.lit(NO_SESSION)).alias("last_session"), calls.alias("calls"))
    custom = F.lit(NO_TOOLS)
    if custom_summary is not None:
        texts = custom_summary_udf(custom_summary)(F.to_json("calls"))
        custom = _or_none(texts)
    parts = parts.withColumn("custom_tool_summary", custom)
    return parts.select("query_id", "uuid", _fill(template).alias("context"))


FIELDS = ("agent_response", "tool_summary", "simplified_tool_summary", "custom_tool_summary", "last_session", "query_text")


def _fill(template: str) -> Column:
    """The template split at its placeholders, so that a value is never searched for placeholders."""
    pieces, rest = [], template
    while rest:
        found = [(rest.find("{" + f + "}"), f) for f in FIELDS if "{" + f + "}" in rest]
        if not found:
            pieces.append(F.lit(rest))
            break
        at, name = min(found)
        pieces += [F.lit(rest[:at]), F.col(name)]
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def _or_none(text: Column) -> Column:
    return F.coalesce(F.when(text != "", text), F.lit(NO_TOOLS))


def custom_summary_udf(fn: Callable[[dict], str]):
    """Pandas UDF: a JSON list of calls to the joined texts of ``fn``."""
    import json

    @F.pandas_udf("string")
    def texts(calls: pd.Series) -> pd.Series:
        return calls.map(lambda c: ", ".join(fn(t) for t in json.loads(c)) if c else "")

    return texts
