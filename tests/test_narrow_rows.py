"""Vectors of facts stay where they lie: they are neither written again nor joined with owners or ends."""

import datetime as dt
import json

from palimpsest.operators import ingest, joins, maintain
from palimpsest.plans import retrieval
from palimpsest.sources import tables
from palimpsest.sources.standins import Standins

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def test_search_keeps_vectors_apart(spark, monkeypatch):
    written = []
    whole = retrieval.stage
    monkeypatch.setattr(retrieval, "stage", lambda df, *a: written.append(df.columns) or whole(df, *a))
    s = Standins(spark, SF)
    g = retrieval.stored_graph(s)
    assert len(written) == 2 and not any("fact_embedding" in c for c in written)
    columns = ["uuid", "user_id", "created_at", "expired_at", "fact_embedding"]
    rows = lambda df: sorted((r.uuid, r.user_id, r.created_at, r.expired_at, tuple(r.fact_embedding)) for r in df.select(*columns).collect())
    owned = retrieval.search.edges_with_owner(s.edges(), s.entities()).filter("fact_embedding IS NOT NULL")
    assert rows(g.fact_vectors) == rows(owned)


def test_pruning_writes_no_vectors(spark, monkeypatch):
    written = []
    whole = maintain.stage
    monkeypatch.setattr(maintain, "stage", lambda df, *a: written.append(df.columns) or whole(df, *a))
    day = dt.timedelta(days=1)
    edges = spark.createDataFrame([
        ("a", "x", "y", "f", [1.0, 0.0], T0, None, ["o1"], 2), ("b", "y", "x", "f", [1.0, 0.01], T0 + day, None, ["o2"], 3),
        ("c", "x", "z", "f", [1.0, 0.0], T0, None, ["o3"], 1), ("d", "x", "w", "f", [1.0, 0.0], T0, None, ["o4"], 1),
        ("e", "x", "y", "f", None, T0, None, ["o5"], 1), ("g", "x", "y", "f", [1.0, 0.0], T0, T0, ["o6"], 1)],
        "uuid string, source_uuid string, target_uuid string, fact string, fact_embedding array<float>, created_at timestamp, expired_at timestamp, episodes array<string>, mentions long")
    entities = spark.createDataFrame([(u, "ann", 1 if u == "w" else 9, T0) for u in "wxyz"], "uuid string, user_id string, mentions long, created_at timestamp")
    mentions = spark.createDataFrame([("m1", "w"), ("m2", "x")], "uuid string, entity_uuid string")
    tables, counts = maintain.prune_all(entities, edges, mentions, reference_time="2025-01-01")
    assert tuple(counts.first()) == (1, 1, 1)
    assert sorted((r.uuid, r.mentions, r.episodes) for r in tables["edges"].collect()) == [("a", 5, ["o1", "o2"]), ("c", 1, ["o3"]), ("e", 1, ["o5"])]
    assert [r.uuid for r in tables["mentions"].collect()] == ["m2"]
    assert not any("fact_embedding" in c for c in written)


def test_export_adds_vectors_after_names(spark):
    s = Standins(spark, SF)
    late = tables.export_documents({"entities": s.entities(), "edges": s.plain_edges().drop("user_id")}, wide={"edges": s.with_vectors})
    once = tables.export_documents({"entities": s.entities(), "edges": s.edges()})
    rows = lambda docs: sorted((json.loads(r.value) for r in docs["edges"].collect()), key=lambda d: d["uuid"])
    assert rows(late) == rows(once) and any("fact_embedding" in d for d in rows(late))


def test_relations_get_vectors_when_ends_are_known(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, vec array<double>")
    found = spark.createDataFrame([("u", "a", "b", "knows", "f1", 1), ("u", "a", "c", "knows", "f2", 3), ("u", "a", "?", "knows", "f3", 1), ("u", "b", "a", "knows", "f4", None)],
                                  "user_id string, source string, target string, relation string, fact string, vec_id long")
    entities = spark.createDataFrame([("u", n, f"i{n}") for n in "abc"], "user_id string, name string, uuid string")
    edges = spark.createDataFrame([("e1", "ia", "ib", 2, None), ("e2", "ia", "ic", 1, None), ("e3", "ib", "ia", 1, None)],
                                  "uuid string, source_uuid string, target_uuid string, vec_id long, expired_at timestamp")
    wide = lambda df, name: df.join(vectors.withColumnRenamed("vec", name), "vec_id", "left").drop("vec_id")
    rows = lambda df: sorted((r.fact, r.uuid, r.source_uuid, r.target_uuid, r.mentions, r.is_new) for r in df.collect())
    apart = rows(ingest.resolve_relations(found, entities, edges, vectors=vectors))
    assert apart == rows(ingest.resolve_relations(wide(found, "embedding"), entities, wide(edges, "fact_embedding")))
    assert [(r[0], r[1], r[5]) for r in apart if not r[5]] == [("f1", "e1", False)] and [r[0] for r in apart] == ["f1", "f2", "f4"]


def test_calls_of_an_episode_are_placed_once(spark):
    plan = Standins(spark, SF).query_episodes()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_documents_are_parsed_once(spark):
    rows = spark.createDataFrame([("a", '{"integration":"adk"}'), ("b", "{broken"), ("c", None)], "uuid string, metadata string")
    parsed = joins.metadata_struct(rows).select("uuid", "meta.integration")
    assert [tuple(r) for r in parsed.collect()] == [("a", "adk")]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_exact_keys_are_narrow(spark, monkeypatch):
    """User and text travel as one key of 32 bytes; a user's end and a text's beginning are told apart, null and empty are the same."""
    from palimpsest.operators import dedup

    seen, within = [], dedup.dedup_within
    monkeypatch.setattr(dedup, "dedup_within", lambda df, **named: seen.append((df.dtypes, named["keys"])) or within(df, **named))
    rows = [("1", "a", "bc"), ("2", "ab", "c"), ("3", None, ""), ("4", "", None), ("5", "a", "bc")]
    df = spark.createDataFrame(rows, "uuid string, user_id string, content string").selectExpr("*", "timestamp_seconds(cast(uuid as int)) as created_at")
    got = {r["input_id"]: r["canonical_uuid"] for r in dedup.dedup_exact(df).collect()}
    assert got == {"1": "1", "2": "2", "3": "3", "4": "3", "5": "1"}
    assert seen == [([("uuid", "string"), ("created_at", "timestamp"), ("ck", "binary")], ["ck"])]
