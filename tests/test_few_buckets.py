"""A store with few buckets: rows are dealt by key to many tasks, first rows are not moved at all, and the table is the same."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import keyed_store, upserts
from palimpsest.operators.keyed_store import KeyedStore


@pytest.fixture
def many_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_buckets_many_tasks(spark, tmp_path, many_tasks, monkeypatch):
    old = spark.createDataFrame([(f"k{i}", 1, "x") for i in range(300)], "k string, n long, uuid string")
    rows = spark.createDataFrame([(f"k{i % 400}", i, f"p{i}", i) for i in range(100, 900)], "k string, n long, uuid string, created_at int")
    moved = []
    placed = KeyedStore.placed
    monkeypatch.setattr(KeyedStore, "placed", lambda self, rows: moved.append(1) or placed(self, rows))

    def table(root):
        moved.clear()
        store = KeyedStore.create(spark, f"{tmp_path}/{root}", old, ["k"], {"n": "sum", "uuid": "new"}, buckets=2)
        created = len(moved)
        batch = store.placed(rows)
        store = store.apply(upserts.latest(batch, ["_bucket", "k"], n=F.sum("n")))
        plain, packed = (sorted(tuple(r) for r in x.read().collect()) for x in (store, store.compact()))
        assert plain == packed and len(plain) == 400
        return created, batch.filter("k IS NOT NULL").select(F.spark_partition_id()).distinct().count(), plain

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        created, tasks, few = table("few")
        assert created == 0 and tasks > 30
        monkeypatch.setattr(keyed_store, "BUCKET_TASKS", 1000)
        created, tasks, by_bucket = table("by_bucket")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert created == 1 and tasks <= 2 and few == by_bucket
