"""Small literal cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import privacy, scoring, text, values
from palimpsest.operators import augment, community, filters, fusion, ingest, joins, maintain, metadata, runs, search
from palimpsest.sources import tables
from palimpsest.streaming import incremental as inc

T0 = dt.datetime(2024, 1, 1)
EP = ("uuid string, name string, content string, content_embedding array<float>, source string, kind string, "
      "created_at timestamp, user_id string, metadata string")


def episodes(spark, rows):
    """rows: (uuid, content, user, metadata dict, hours)"""
    return spark.createDataFrame(
        [(u, u, c, None, "message", "query", T0 + dt.timedelta(hours=h), user, json.dumps(m) if isinstance(m, dict) else m)
         for u, c, user, m, h in rows], EP)


def one(spark, col, **vals):
    return spark.createDataFrame([tuple(vals.values())], list(vals)).select(col).first()[0]


LANGS = [
    ("e1", "Python is a high-level programming language known for readability", "u1", {"tags": ["python", "programming"]}, 0),
    ("e2", "JavaScript is used for web development and runs in browsers", "u1", {"tags": ["javascript", "Web"]}, 1),
    ("e3", "PostgreSQL is a powerful relational database system", "u1", {"tags": ["database", "postgresql"]}, 2),
    ("e4", "my passwords are hidden", "u2", {"tags": []}, 3),
]


def graph(spark, rows=LANGS):
    empty = spark.createDataFrame([], "uuid string, name string, entity_type string, summary string, name_embedding array<float>, mentions long, created_at timestamp, user_id string")
    edges = spark.createDataFrame([], "uuid string, source_uuid string, target_uuid string, name string, fact string, fact_embedding array<float>, created_at timestamp, valid_at timestamp, invalid_at timestamp, expired_at timestamp, user_id string")
    mentions = spark.createDataFrame([], "uuid string, episode_uuid string, entity_uuid string, created_at timestamp")
    return search.Graph(episodes(spark, rows), empty, edges, mentions)


def ask(spark, *texts, user=None):
    return spark.createDataFrame([(i, t, None, user) for i, t in enumerate(texts)],
                                 "query_id long, text string, embedding array<float>, user_id string")


def found(spark, cfg, strategy, *texts, user=None):
    out = search.search(graph(spark), ask(spark, *texts, user=user), cfg, strategy)
    return [(r.query_id, r.uuid) for r in out.orderBy("query_id", "rank").collect()]


BASE = search.SearchConfig(enable_embeddings=False, apply_decay=False, reference_time="2024-02-01")


def test_keyword_search_cases(spark):
    got = found(spark, BASE, "bm25", "programming language", "python readability", "PYTHON", "quantum superposition")
    assert [g for g in got if g[0] < 3] == [(0, "e1"), (1, "e1"), (2, "e1")]
    assert not [g for g in got if g[0] == 3]
    assert found(spark, BASE, "hybrid", "python", user="nobody") == []
    assert found(spark, BASE, "semantic", "passwords", user="u1") == []
    assert found(spark, BASE, "bm25", "passwords", user="u2") == [(0, "e4")]


def test_tag_modes_and_tag_only(spark):
    cfg = search.without(BASE, tags=("web", "database"))
    assert found(spark, cfg, "hybrid", "") == [(0, "e3"), (0, "e2")]
    assert found(spark, search.without(cfg, tag_match_mode="all"), "hybrid", "") == []
    with pytest.raises(ValueError):
        filters.by_tags(graph(spark).episodes, ["x"], "some")
    with pytest.raises(ValueError):
        search.search(graph(spark), ask(spark, "x"), BASE, "magic")


def test_rrf_is_order_free_and_limited(spark):
    a = spark.createDataFrame([(0, "episode", f"x{i}", i) for i in range(1, 6)], "query_id long, kind string, uuid string, rank int")
    b = spark.createDataFrame([(0, "episode", f"x{6 - i}", i) for i in range(1, 6)], "query_id long, kind string, uuid string, rank int")
    ab, ba = (sorted(map(tuple, fusion.rrf_fuse(ls, limit=3).collect())) for ls in ([a, b], [b, a]))
    assert ab == ba and len(ab) == 3
    assert ab[0][3] == pytest.approx(1 / 61 + 1 / 65, abs=1e-6)


def test_decay_and_boost(spark):
    df = spark.createDataFrame([(T0, None), (T0 - dt.timedelta(days=10, hours=5), T0 - dt.timedelta(days=1)),
                                (T0 + dt.timedelta(days=9), None)], "c timestamp, i timestamp")
    decay = [r[0] for r in df.select(scoring.temporal_decay(F.lit(1.0), F.col("c"), T0)).collect()]
    assert decay == pytest.approx([1.0, 0.95 ** 10, 1.0])
    boost = [r[0] for r in df.select(scoring.update_boost(F.lit(1.0), F.col("c"), T0, invalid_at=F.col("i"))).collect()]
    assert boost == pytest.approx([1.2, 0.96, 1.2])


@pytest.mark.parametrize("raw,want", [
    ("Contact me at john.doe@example.com for details", "Contact me at [EMAIL] for details"),
    ("Call me at 555-123-4567", "Call me at [PHONE]"), ("ssn 123-45-6789", "ssn [SSN]"),
    ("card 4111 1111 1111 1111", "card [CARD]"), ("nothing here", "nothing here")])
def test_pii(spark, raw, want):
    assert one(spark, privacy.pii_mask(F.col("t")), t=raw) == want


def test_params_and_outputs(spark):
    p = {"username": "bob", "password": "x", "API_KEY": "y", "data": "a@b.co"}
    got = one(spark, privacy.redact_params(F.col("p")), p=p)
    assert got == {"username": "bob", "password": "[REDACTED]", "API_KEY": "[REDACTED]", "data": "[EMAIL]"}
    long = one(spark, privacy.summarize_output(F.col("t"), 50), t="x" * 100)
    assert long == "x" * 50 + "... [truncated, total length: 100]"
    assert one(spark, privacy.summarize_output(F.col("t"), 50, summarize=False), t="x" * 100) == "x" * 50
    assert one(spark, privacy.summarize_output(F.lit(None).cast("string")), t="x") == "None"
    assert one(spark, privacy.mask_sensitive(F.col("t")), t="sk-1234567890") == "sk-1***567890"
    assert one(spark, values.response_size(F.col("t")), t=" N/A ") == "None"


def test_tokens_split_as_python_does(spark):
    s = "Ünï code space wide\x1funit　x  y\n"
    assert one(spark, text.tokenize(F.col("t")), t=s) == s.lower().split()


def test_sampling_extremes(spark):
    df = spark.range(200)
    assert df.filter(values.keep_sample(F.col("id"), 1.0)).count() == 200
    assert df.filter(values.keep_sample(F.col("id"), 0.0)).count() == 0


CALLS = [{"tool_name": "search", "success": True, "duration_ms": 5, "timestamp": "2024-01-01T00:00:00", "input_params": {"q": "a"}, "output_summary": "found"},
         {"tool_name": "search", "success": False, "duration_ms": 7, "timestamp": "2024-01-01T00:01:00", "input_params": {"q": "b"}, "output_summary": "bad", "error": "E1"},
         {"tool_name": "ping", "success": True, "duration_ms": 1, "timestamp": "2024-01-01T00:02:00", "output_summary": "None"}]


def run(i, at, **more):
    return {"run_id": f"r{i}", "user_id": "u1", "timestamp": at, "query": "help", "tools_used": [], **more}


def test_latest_session_wins(spark):
    meta = lambda s, h: {"sessions": {s: [run(1, f"2024-01-01T0{h}:00:00")]}}
    eps = episodes(spark, [("a", "Show me the database schema", "u", meta("s3", 3), 0), ("b", "Please help", "u", meta("s5", 5), 0), ("c", "bad", "u", "{oops", 0)])
    hits = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3), (1, "a", 1)], "query_id long, uuid string, rank int")
    assert {r.query_id: r.session_id for r in runs.latest_session(eps, hits).collect()} == {0: "s5", 1: "s3"}


def test_legacy_calls_and_stats(spark):
    eps = episodes(spark, [("old", "x", "u", {"tools_used": CALLS}, 0), ("new", "y", "u", {"sessions": {"s": [run(1, "2024-01-01T00:00:00", tools_used=CALLS)]}}, 1)])
    stats = {r.tool_name: r for r in runs.tool_stats(runs.explode_tools(eps)).collect()}
    assert (stats["search"].usage_count, stats["search"].failure_count, stats["search"].success_rate) == (4, 2, 0.5)
    assert [e.error for e in stats["search"].recent_errors] == ["E1", "E1"]
    assert stats["ping"].recent_errors == []


def test_metadata_updates_keep_unknown_keys(spark):
    meta = {"tags": ["t"], "custom": {"deep": [1, 2]}, "sessions": {"s": [run(1, "2024-01-01T00:00:00")], "empty": []}}
    eps = episodes(spark, [("a", "x", "u", meta, 0), ("b", "y", "u", {"tags": ["only"]}, 0)])
    r = "struct<run_id:string,user_id:string,timestamp:string,query:string,augmented_query:string,agent_response:string,tools_used:array<struct<tool_name:string,success:boolean,duration_ms:bigint,timestamp:string,input_params:map<string,string>,output_summary:string,error:string,parent_tool_name:string>>,llm_saved_memory:string>"
    blank = (None,) * 6
    ups = spark.createDataFrame([("a", sess, T0 + dt.timedelta(minutes=n), (rid, "u1", *blank)) for n, (sess, rid) in enumerate(
        [("s", "r1"), ("s", "r2"), ("s", "r2"), ("empty", "r9"), ("fresh", "r1")])], f"episode_uuid string, session_id string, run_at timestamp, run {r}")
    out = {x.uuid: json.loads(x.metadata) for x in metadata.append_run(eps, ups).collect()}
    assert {k: [q["run_id"] for q in v] for k, v in out["a"]["sessions"].items()} == {"s": ["r1", "r2"], "empty": [], "fresh": ["r1"]}
    assert out["a"]["custom"] == {"deep": [1, 2]} and out["a"]["tags"] == ["t"] and out["b"] == {"tags": ["only"]}


def test_augmented_context(spark):
    meta = {"sessions": {"s1": [run(1, "2024-01-01T00:00:00", agent_response="use the index", tools_used=CALLS)]}}
    eps = episodes(spark, [("a", "Help me with a task", "u1", meta, 0), ("b", "Help me with a task", "u2", meta, 0)])
    q = ask(spark, "Help me with a task", "unrelated", user="u1")
    tmpl = "{agent_response}|{tool_summary}|{simplified_tool_summary}|{custom_tool_summary}|{query_text}|{last_session}"
    out = augment.augment_context(eps, q, template=tmpl, custom_summary=lambda t: "Result was there" if t.get("output_summary") != "None" else "No Result").collect()
    assert [(r.query_id, r.uuid) for r in out] == [(0, "a")]
    head, tools, simple, custom, query, last = out[0].context.split("|")
    assert head == "use the index" and query == "Help me with a task"
    assert tools == "search with [q=a] -> found, search with [q=b] -> bad, ping -> []"
    assert simple == "search with [q=a (response: 5 chars)]; failed with [q=b (response: 3 chars) [error: E1]]"
    assert custom == "Result was there, Result was there, No Result"
    assert last.startswith("Session ID: s1\n\nRuns in this session: 1\n\n--- Run 1 ---\nTimestamp: 2024-01-01T00:00:00\nQuery: help\nAgent Response: use the index\nTools Used (3):\n  - search with [q=a] -> found (success: True, duration: 5ms)")


EDGE = "uuid string, source_uuid string, target_uuid string, name string, fact string, fact_embedding array<float>, created_at timestamp, valid_at timestamp, invalid_at timestamp, expired_at timestamp, episodes array<string>, mentions long"


def edge(i, s, t, name, day, expired=None, vec=None):
    at = T0 + dt.timedelta(days=day)
    return (i, s, t, name, f"{s} {name} {t}", vec, at, at, None, expired, [f"ep_{i}"], 1)


def test_facts_as_of_after_a_move(spark):
    e = spark.createDataFrame([edge("1", "alice", "google", "WORKS_AT", 0), edge("2", "alice", "openai", "WORKS_AT", 30), edge("3", "alice", "bob", "KNOWS", 1)], EDGE)
    ended = ingest.invalidate_contradictions(e, ["WORKS_AT"], T0 + dt.timedelta(days=60))
    assert {r.uuid: r.expired_at for r in ended.collect()} == {"1": T0 + dt.timedelta(days=60), "2": None, "3": None}
    at = lambda day: {r.uuid for r in filters.facts_as_of(ended.withColumn("expired_at", F.lit(None).cast("timestamp")), valid_time=T0 + dt.timedelta(days=day), system_time=T0 + dt.timedelta(days=90)).collect()}
    assert at(10) == {"1", "3"} and at(40) == {"2", "3"}


def test_compaction_merges_and_is_idempotent(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    e = spark.createDataFrame([edge("1", "a", "b", "R", 0, vec=v), edge("2", "b", "a", "R", 1, vec=v), edge("3", "a", "b", "R", 2, vec=w), edge("4", "a", "c", "R", 0)], EDGE)
    once = maintain.compact_redundant_edges(e)
    rows = {r.uuid: (r.mentions, r.episodes) for r in once.collect()}
    assert rows == {"1": (2, ["ep_1", "ep_2"]), "3": (1, ["ep_3"]), "4": (1, ["ep_4"])}
    assert maintain.redundant_edges(once).filter("id <> keeper").isEmpty()


def test_prune_rejects_bad_parameters(spark):
    e = spark.createDataFrame([edge("1", "a", "b", "R", 0)], EDGE)
    with pytest.raises(ValueError):
        maintain.prune_expired_edges(e, reference_time=T0, cutoff_days=0)
    with pytest.raises(ValueError):
        maintain.prune_low_mention_entities(e, e, e, reference_time=T0, min_mentions=0)


def test_snapshot_and_records_round_trip(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"content": "hi", "session_id": "s\\"1"}\n{"content": "yo", "source": "json", "user_id": "u"}\n')
    eps = tables.batch_to_episodes(tables.read_records(spark, str(tmp_path / "in.json")), reference_time=T0)
    rows = {r.content: r for r in eps.collect()}
    assert json.loads(rows["hi"].metadata) == {"sessions": {'s"1': []}} and rows["hi"].source == "text" and rows["yo"].source == "json"
    tables.write_snapshot({"mentions": spark.createDataFrame([("m", "e", "n", T0)], "uuid string, episode_uuid string, entity_uuid string, created_at timestamp")}, str(tmp_path), "v1")
    assert tables.read_table(spark, str(tmp_path / "v1"), "mentions").count() == 1
    bad = spark.createDataFrame([("x", "carrier pigeon")], "content string, source string")
    with pytest.raises(Exception, match="unknown source"):
        tables.batch_to_episodes(bad, reference_time=T0).collect()


def test_model_hook_runs_on_batches(spark):
    out = ingest.map_model(spark.createDataFrame([("a b",), ("c",)], "t string"), lambda: lambda pdf: pdf.assign(n=pdf["t"].str.split().str.len()), "t string, n long")
    assert {r.t: r.n for r in out.collect()} == {"a b": 2, "c": 1}


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    from palimpsest.operators.dedup import dedup_exact
    rows = [(f"e{i:02d}", f"text {i % 3}", f"u{i % 2}", {}, 5 * i) for i in range(40)]
    eps = episodes(spark, rows).select("uuid", "created_at", "user_id", "content")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(4):  # arriving in time order, one file per batch
        eps.filter((F.substring("uuid", 2, 2).cast("int") / 10).cast("int") == n).coalesce(1).write.mode("append").parquet(src)
        inc.stream_dedup_exact(inc.table_stream(spark, src, "*.parquet", 1), out, out + "-cp").awaitTermination()
    got = {r.uuid: r.canonical_uuid for r in spark.read.parquet(out).collect()}
    assert got == {r.input_id: r.canonical_uuid for r in dedup_exact(eps).collect()}


def test_staged_tables_are_released(spark):
    from palimpsest import session

    df = session.stage(spark.range(5))
    assert df.count() == 5 and session.release_staged(spark) >= 1
    assert session.release_staged(spark) == 0


def test_broadcast_is_bound_by_bytes(spark):
    from palimpsest.operators import skew

    df = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array_repeat(F.lit(1.0), 100).alias("v"))
    assert skew.is_small(df) and not skew.is_small(df, max_rows=9) and not skew.is_small(df, max_bytes=15_000)


def test_new_sessions_keep_all_their_runs(spark):
    eps = episodes(spark, [("old", "x", "u", {"sessions": {"s": [run(1, "2024-01-01T00:00:00")]}}, 0)])
    runs_in = spark.createDataFrame([("new", "u", "first", T0, ("a",)), ("new", "u", "second", T0 + dt.timedelta(1), ("b",)), ("s", "u", "more", T0, ("c",))],
                                    "session_id string, user_id string, content string, run_at timestamp, run struct<run_id:string>")
    append, create = runs.prepare_query_runs(eps, runs_in)
    made = create.collect()
    assert [(r.session_id, r.content) for r in made] == [("new", "first")]
    assert sorted((r.run.run_id, r.episode_uuid) for r in append.collect()) == [("a", made[0].uuid), ("b", made[0].uuid), ("c", "old")]


def test_malformed_metadata_is_dropped_and_names_have_words(spark):
    eps = episodes(spark, [("ok", "Alice  Smith, went to (Google).", "u", {"tags": []}, 0)])
    bad = eps.withColumn("metadata", F.lit("{not json"))
    assert joins.metadata_struct(bad).count() == 0 and joins.metadata_struct(eps).count() == 1
    words = spark.createDataFrame([("Alice Smith", "person"), ("google", "org")], "name string, entity_type string")
    assert sorted((r.name, r.position) for r in ingest.extract_entities(eps, words).collect()) == [("alice_smith", 0), ("google", 4)]


def test_components_read_the_edges_in_one_round_only(spark, monkeypatch):
    path = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40) if i != 20] + [("n05", "n05"), ("n03", "n02")]
    sizes, stage = [], community.stage
    monkeypatch.setattr(community, "stage", lambda df: (lambda out: (sizes.append(out.count()) if out.columns == ["a", "b"] else None, out)[1])(stage(df)))
    got = {r.uuid: r.component for r in community.connected_components(spark.createDataFrame(path, "source_uuid string, target_uuid string")).collect()}
    assert got == {f"n{i:02d}": "n00" if i <= 20 else "n21" for i in range(41)}
    assert sizes[0] == 39 and sizes[-1] == 0 and all(2 * b <= a for a, b in zip(sizes, sizes[1:]))
