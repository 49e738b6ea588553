"""Queries of the same user and text are asked once; the rows are the same as without."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import bm25
from palimpsest.operators.keyword_store import KeywordStore
from palimpsest.streaming import incremental as inc

T0 = dt.datetime(2024, 1, 1)


def keyword_case(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9)]
    docs = spark.createDataFrame([(f"d{i}", rng.choice(("ann", "bob", None)), T0 + dt.timedelta(days=rng.randrange(5)), " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(80)],
                                 "uuid string, user_id string, created_at timestamp, txt string")
    texts = [" ".join(rng.choices(words, k=2)) for _ in range(6)]
    queries = spark.createDataFrame([(i, rng.choice((None, "", "ann", "bob")), rng.choice(texts)) for i in range(120)] + [(500, "ann", None)], "query_id long, user_id string, text string")
    return bm25.documents(docs, F.col("txt")), queries


@pytest.mark.parametrize("kept", [False, True])
def test_equal_queries_are_asked_once(spark, monkeypatch, kept):
    docs, queries = keyword_case(spark)
    index = KeywordStore.create(spark, inc.fresh_path(spark, "keywords"), buckets=2).add(docs) if kept else bm25.build(docs)
    one_by_one = {}
    for r in bm25.score(bm25.build(docs), queries).collect():
        one_by_one.setdefault(r.query_id, []).append((-r.score, -r.created_at.timestamp(), r.uuid))
    want = sorted((q, u, -s, i + 1) for q, hits in one_by_one.items() for i, (s, _, u) in enumerate(sorted(h for h in hits if -h[0] >= 0.01)[:4]))
    asked = []
    whole = (KeywordStore if kept else bm25).score

    def counted(*args, **named):
        asked.append(args[1].count())
        return whole(*args, **named)

    monkeypatch.setattr(KeywordStore if kept else bm25, "score", counted)
    found = index.search(queries, limit=4) if kept else bm25.search(index, queries, limit=4)
    assert sorted((r.query_id, r.uuid, r.score, r["rank"]) for r in found.collect()) == want
    assert asked and asked[0] <= 6 * 3
