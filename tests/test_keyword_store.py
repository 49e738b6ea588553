"""The stored keyword index against the index that is built for one search."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import bm25
from palimpsest.operators.keyword_store import KeywordStore
from palimpsest.sources.manifest import Manifest
from palimpsest.streaming.incremental import fresh_path

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n, seed=1, prefix="d"):
    rng = random.Random(seed)
    # a word in nearly every document, so that negative weights occur only when asked for
    rows = [(f"{prefix}{i}", rng.choice(("ann", "bob", None)), f"2024-01-{rng.randrange(1, 28):02d} 00:00:00",
             " ".join(WORDS[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.choice((0, 1, 5, 30)))), rng.choice(("a", "b"))) for i in range(n)]
    df = spark.createDataFrame(rows, "uuid string, user_id string, created_at string, txt string, grp string")
    return bm25.documents(df.withColumn("created_at", F.col("created_at").cast("timestamp")), F.col("txt"), "grp")


def asked(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice((None, "", "ann", "bob")), " ".join(rng.choice(WORDS + ["unknown"]) for _ in range(rng.choice((1, 2, 4, 9))))) for i in range(25)]
    return spark.createDataFrame(rows + [(90, None, ""), (91, None, "W0 w0 w1")], "query_id long, user_id string, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "uuid", "score").collect())


def best(df):
    return sorted(tuple(r) for r in df.select("query_id", "uuid", "score", "rank").collect())


@pytest.fixture(scope="module")
def grown(spark):
    """An index of two segments, from which some documents were removed."""
    root = fresh_path(spark, "keywords")
    one, two = corpus(spark, 300), corpus(spark, 200, 2, "e")
    store = KeywordStore.create(spark, root, buckets=4, carried={"grp": "string"}).add(one).add(two)
    gone = spark.createDataFrame([(f"d{i}",) for i in range(0, 300, 7)] + [("e3",), ("nobody",)], "uuid string")
    return store, store.remove(gone), one.unionByName(two), one.unionByName(two).join(gone, "uuid", "left_anti")


def test_added_segments(spark, grown):
    store, _, docs, _ = grown
    assert rows(store.score(asked(spark))) == rows(bm25.score(bm25.build(docs), asked(spark)))
    assert store.stats() == {"documents": 500, "tokens": docs.agg(F.sum(F.size("tokens"))).first()[0], "segments": 2, "tombstones": 0}


def test_removed_documents(spark, grown):
    _, store, _, left = grown
    assert rows(store.score(asked(spark))) == rows(bm25.score(bm25.build(left), asked(spark)))
    assert store.remove(spark.createDataFrame([("nobody",)], "uuid string")) is store


def test_merged(spark, grown):
    _, store, _, left = grown
    merged = KeywordStore.load(spark, store.root, store.version).merge()
    assert merged.stats()["segments"] == 1 and merged.stats()["tombstones"] == 0
    assert rows(merged.score(asked(spark))) == rows(bm25.score(bm25.build(left), asked(spark)))


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_skipping_blocks_keeps_the_list(spark, grown, limit, monkeypatch):
    monkeypatch.setattr("palimpsest.operators.keyword_store.BLOCK_ROWS", 4)
    docs = corpus(spark, 400, 3)
    store = KeywordStore.create(spark, fresh_path(spark, "keywords"), buckets=3, carried={"grp": "string"}).add(docs)
    assert store.postings().agg(F.max("block")).first()[0] > 5
    where = lambda df: df.filter("grp = 'a'")
    index = bm25.build(docs)
    expected = bm25.search(index, asked(spark), candidates=where(index.docs), limit=limit)
    assert best(store.search(asked(spark), where=where, limit=limit, skip_from=0)) == best(expected)
    assert best(store.search(asked(spark), limit=limit, skip_from=0)) == best(bm25.search(index, asked(spark), limit=limit))
    opened = []
    original = KeywordStore._without_skipped

    def counted(self, join, *rest):
        out = original(self, join, *rest)
        opened.append((out.count(), join.count()))
        return out

    monkeypatch.setattr(KeywordStore, "_without_skipped", counted)
    best(store.search(spark.createDataFrame([(1, None, "w9")], "query_id long, user_id string, text string"), limit=limit, skip_from=0))
    assert opened[0][0] <= opened[0][1]
    if limit == 1:
        assert opened[0][0] < opened[0][1]


def test_chains_and_filters(spark, grown, monkeypatch):
    monkeypatch.setattr("palimpsest.operators.keyword_store.CHAIN_ROWS", 20)
    monkeypatch.setattr("palimpsest.operators.keyword_store.LISTED_TOKENS", 2)
    docs = corpus(spark, 300)
    store = KeywordStore.create(spark, fresh_path(spark, "keywords"), buckets=2, carried={"grp": "string"}).add(docs)
    some = docs.filter("uuid like '%3'")
    assert rows(store.score(asked(spark), candidates=some)) == rows(bm25.score(bm25.build(docs), asked(spark), candidates=some))


def test_versions(spark, grown):
    store, removed, docs, left = grown
    again = KeywordStore.load(spark, store.root, store.version)
    assert again.state == store.state and again.documents().count() == 500
    with pytest.raises(RuntimeError, match="somebody else"):
        store.add(corpus(spark, 3, 9, "x"))
    newest = KeywordStore.load(spark, store.root)
    assert newest.vacuum() >= 0 and Manifest(spark, store.root).versions() == [newest.version]
    assert rows(newest.score(asked(spark))) == rows(bm25.score(bm25.build(left), asked(spark)))
    with pytest.raises(ValueError, match="no version"):
        KeywordStore.load(spark, store.root, 1)
    with pytest.raises(ValueError, match="no index"):
        KeywordStore.load(spark, fresh_path(spark, "nothing"))


def test_empty(spark):
    store = KeywordStore.create(spark, fresh_path(spark, "keywords"), carried={"grp": "string"})
    assert rows(store.score(asked(spark))) == []
    store = store.add(corpus(spark, 5).limit(0))
    assert rows(store.search(asked(spark))) == [] and store.stats()["documents"] == 0


def test_postings_move_once(spark, tmp_path, monkeypatch):
    """One row for each word of a document is shuffled, once; blocks go on where an Arrow batch ends."""
    from palimpsest.operators import keyword_store

    plans, blocks_of = [], keyword_store._blocks

    def seen(rows, keys):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return blocks_of(rows, keys)

    monkeypatch.setattr(keyword_store, "_blocks", seen)
    monkeypatch.setattr(keyword_store, "BLOCK_ROWS", 4)
    rows = [(f"d{i}", None, None, ["x"] * (1 + i % 5) + [f"w{i % 3}"]) for i in range(41)]
    df = spark.createDataFrame(rows, "uuid string, user_id string, created_at timestamp, tokens array<string>")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        store = KeywordStore.create(spark, f"{tmp_path}/store", buckets=2).add(df)
        got = store.postings().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1]
    for tok in ("x", "w0", "w1", "w2"):
        mine = sorted((r for r in got if r["tok"] == tok), key=lambda r: r["block"])
        docs = [(d["uuid"], d["dl"], d["tf"]) for r in mine for d in r["docs"]]
        assert sorted(docs) == sorted((u, len(t), t.count(tok)) for u, _, _, t in rows if tok in t)
        assert [r["block"] for r in mine] == list(range(len(mine))) and all(len(r["docs"]) == 4 for r in mine[:-1])
        assert all(r["max_tf"] == max(d["tf"] for d in r["docs"]) and r["min_dl"] == min(d["dl"] for d in r["docs"]) for r in mine)
