"""The upsert log against the merge of whole tables, and what its batches write."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import upserts
from palimpsest.operators.keyed_store import KeyedStore
from palimpsest.sources.manifest import Manifest
from palimpsest.streaming.incremental import fresh_path, stream_upsert_log

SCHEMA = "id string, n long, fact string, note string, eps array<string>, made timestamp"
RULES = {"n": "sum", "fact": "new", "note": "new_if_set", "eps": "union"}


def merged(table, update):
    return upserts.merge(table, update, ["id"], {"n": F.col("t.n") + F.col("u.n"), "fact": "new", "note": "new_if_set",
                                                 "eps": F.array_sort(F.array_distinct(F.concat("t.eps", "u.eps")))})


def batch(spark, rng, size, keys=40):
    ids = rng.sample(range(keys), size)
    rows = [(f"k{i}", rng.randrange(5), rng.choice((None, "a", "b")), rng.choice((None, None, "x", "y")), rng.sample("pqrs", rng.randrange(3)), None) for i in ids]
    return spark.createDataFrame(rows, SCHEMA).withColumn("made", F.lit(f"2024-01-{rng.randrange(1, 28):02d}").cast("timestamp"))


def rows(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.withColumn("eps", F.array_sort("eps")).collect()), key=repr)


@pytest.mark.parametrize("most", [1, 3, 99])
def test_equals_whole_merges(spark, most):
    rng = random.Random(most)
    table = batch(spark, rng, 15)
    store = KeyedStore.create(spark, fresh_path(spark, "log"), table, ["id"], RULES, buckets=5)
    for k in range(5):
        update = batch(spark, rng, (8, 1, 20, 3, 0)[k])
        table = merged(table, update)
        store = store.apply(update, batch=("s", k), most_entries=most)
        assert max(store.entries_by_bucket().values()) <= most + (most == 1)
        if k % 2 == 0:
            assert rows(store.read()) == rows(table)
    assert rows(store.compact().read()) == rows(table)
    assert rows(KeyedStore.load(spark, store.root).read()) == rows(table)


def test_a_batch_writes_its_buckets_only(spark):
    rng = random.Random(9)
    store = KeyedStore.create(spark, fresh_path(spark, "log"), batch(spark, rng, 40), ["id"], RULES, buckets=16)
    assert len(store.state["entries"][0]["buckets"]) > 8
    one = batch(spark, rng, 1)
    after = store.apply(one, batch=("s", 0))
    assert len(after.state["entries"][1]["buckets"]) == 1
    assert after.log(after.state["entries"][1]["buckets"]).count() < after.log().count()
    assert after.apply(one, batch=("s", 0)) is after  # the same batch again
    assert after.changes(store.version).count() == 1
    assert rows(store.read()) == rows(KeyedStore.load(spark, store.root, store.version).read())  # older versions stay readable
    done = after.compact()
    assert done.vacuum() >= 1 and Manifest(spark, store.root).versions() == [done.version]
    assert len(rows(done.read())) == 40


def test_empty_and_wrong(spark):
    none = batch(spark, random.Random(1), 3).limit(0)
    store = KeyedStore.create(spark, fresh_path(spark, "log"), none, ["id"], RULES)
    assert rows(store.read()) == [] and store.compact() is store
    assert rows(store.apply(none).read()) == []
    with pytest.raises(ValueError, match="unknown"):
        KeyedStore.create(spark, fresh_path(spark, "log"), none, ["id"], {"n": "multiply"})
    with pytest.raises(ValueError, match="no table"):
        KeyedStore.load(spark, fresh_path(spark, "log"))


def test_stream_of_several_batches(spark):
    """Several files, one a batch, equal one merge after another."""
    rng = random.Random(3)
    table = batch(spark, rng, 10)
    folder, root = fresh_path(spark, "in"), fresh_path(spark, "log")
    KeyedStore.create(spark, root, table, ["id"], RULES, buckets=4)
    for k in range(3):
        update = batch(spark, rng, 6)
        update.coalesce(1).write.parquet(f"{folder}/{k}")
        stream = spark.readStream.schema(update.schema).parquet(f"{folder}/*")
        stream_upsert_log(stream, root, root + "-cp", lambda b: b).awaitTermination()
        table = merged(table, spark.read.parquet(f"{folder}/{k}"))
    store = KeyedStore.load(spark, root)
    assert rows(store.read()) == rows(table) and list(store.state["batches"].values()) == [2]


def test_placed_updates_move_once(spark, tmp_path):
    """Updates that are placed and then reduced are written where they lie: one shuffle, and the same table."""
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, n long, uuid string")
    rows = spark.createDataFrame([("a", 2, "p", 1), ("a", 3, "q", 2), ("c", 5, "r", 1)], "k string, n long, uuid string, created_at int")
    store = KeyedStore.create(spark, f"{tmp_path}/s", old, ["k"], {"n": "sum", "uuid": "new"}, buckets=4)
    one = upserts.latest(store.placed(rows), ["_bucket", "k"], n=F.sum("n"))
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    after = store.apply(one)
    want = [("a", 6, "q"), ("b", 1, "y"), ("c", 5, "r")]
    assert sorted(tuple(r) for r in after.read().collect()) == want
    assert sorted(tuple(r) for r in after.compact().read().collect()) == want
    assert after.read()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
