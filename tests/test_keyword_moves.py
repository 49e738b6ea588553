"""A posting of a kept index moves once, to its document, however many queries ask for its word; users and skipped blocks change nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import bm25, keyword_store
from palimpsest.operators.keyword_store import KeywordStore


@pytest.mark.parametrize("users", [("u0", "u1", None), (None,)])
@pytest.mark.parametrize("skip_from", [0, 10**9])
def test_postings_go_to_their_document(spark, tmp_path, monkeypatch, users, skip_from):
    monkeypatch.setattr(keyword_store, "BLOCK_ROWS", 3)
    rng = random.Random(2)
    docs = bm25.documents(spark.createDataFrame(
        [(f"d{i:02d}", (None, "u0", "u1")[i % 3], dt.datetime(2024, 1, 1 + i % 5), " ".join(rng.choices([f"w{k}" for k in range(25)], k=1 + i % 7))) for i in range(90)],
        "uuid string, user_id string, created_at timestamp, text string"), F.col("text"))
    asked = spark.createDataFrame([(i, users[i % len(users)], f"w{i} w{i + 1} w3 w3") for i in range(20)], "query_id long, user_id string, text string")
    store = KeywordStore.create(spark, f"{tmp_path}/k", buckets=4).add(docs.filter("uuid < 'd50'")).add(docs.filter("uuid >= 'd50'"))
    plan = store.score(asked, limit=3, skip_from=skip_from)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(uuid" in plan and "hashpartitioning(query_id" not in plan

    def best(df):
        return sorted(tuple(r) for r in df.select("query_id", "uuid", "score", "rank").collect())

    assert best(store.search(asked, limit=3, skip_from=skip_from)) == best(bm25.search(bm25.build(docs), asked, limit=3))


def test_segments_are_packed(spark, tmp_path):
    docs = bm25.documents(spark.createDataFrame([("a", "u", dt.datetime(2024, 1, 1), "one text")], "uuid string, user_id string, created_at timestamp, text string"), F.col("text"))
    KeywordStore.create(spark, f"{tmp_path}/k", buckets=4).add(docs)
    files = [str(f) for kind in ("docs", "postings") for f in (tmp_path / "k" / kind).rglob("*.parquet")]
    assert files and all(f.endswith(".zstd.parquet") for f in files)
