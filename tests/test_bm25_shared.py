"""Keyword lists where queries share frequent words, and where documents share texts, against scores of every pair."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import bm25
from palimpsest.operators.aggregates import top_per_group


def tables(spark, docs, queries):
    d = spark.createDataFrame(docs, "uuid string, user_id string, created_at timestamp, text string")
    return bm25.build(bm25.documents(d, F.col("text"))), spark.createDataFrame(queries, "query_id long, user_id string, text string")


def plain(index, queries, limit, candidates=None):
    hits = bm25.score(index, queries, candidates).filter("score >= 0.01")
    return {tuple(r) for r in top_per_group(hits, ["query_id"], [F.desc("score"), F.desc_nulls_last("created_at"), "uuid"], limit).select("query_id", "uuid", "score", "rank").collect()}


def found(index, queries, limit, **more):
    return {tuple(r) for r in bm25.search(index, queries, limit=limit, **more).select("query_id", "uuid", "score", "rank").collect()}


def when(n):
    return None if n % 11 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=n % 7)


@pytest.mark.parametrize("vocabulary", [2_000_000, 0])
def test_shared_words(spark, monkeypatch, vocabulary):
    rng = random.Random(3)
    docs = [(f"d{i}", f"u{i % 2}", when(i), " ".join(rng.choice(("red", "blue", "old")) for _ in range(1 + i % 2)) + f" k{rng.randrange(40)} x{i % 9} y{i}") for i in range(120)]
    index, queries = tables(spark, docs, [(i, (None, "u0", "u1")[i % 3], f"k{i} k{i} red" + (" blue" if i % 2 else "")) for i in range(40)] + [(99, "u0", "k1"), (98, None, "red")])
    expected = plain(index, queries, 3)
    scored = []
    monkeypatch.setattr(bm25, "score", lambda *a: scored.append(1))
    monkeypatch.setattr(bm25, "VOCABULARY", vocabulary)
    assert found(index, queries, 3, hot_pairs=100) == expected
    assert not scored  # no row for each pair
    live = index.docs.filter("uuid <> 'd3'")
    monkeypatch.undo()
    assert found(index, queries, 3, hot_pairs=100, candidates=live) == plain(index, queries, 3, live)


def test_equal_texts_are_scored_once(spark, monkeypatch):
    docs = [(f"d{i:03d}", (None, "u0", "u1")[i % 3], when(i), ("red hot iron", "cold  RED sea", "iron sea sea")[i % 5 % 3]) for i in range(90)] + [("own", "u1", None, "a word alone")]
    index, queries = tables(spark, docs, [(0, None, "red"), (1, "u1", "sea iron"), (2, "", "alone"), (3, "u0", "red sea")])
    expected = plain(index, queries, 4)
    sizes, score = [], bm25.score
    monkeypatch.setattr(bm25, "score", lambda i, q, d: sizes.append(d.count()) or score(i, q, d))
    assert found(index, queries, 4) == expected
    assert sizes == [10]
