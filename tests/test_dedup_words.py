"""Words of a batch are counted in their documents and travel packed; too many words, or ids that repeat, go by joins with the same results."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import bm25, dedup


def test_words_travel_packed(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"r{k:02d}", rng.choice(("ann", None)), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(90)),
             " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.choice((0, 2, 5)))) + f" only{k}") for k in range(50)]
    schema = "uuid string, user_id string, created_at timestamp, content string"
    index = bm25.build(bm25.documents(spark.createDataFrame([("r07", "ann", dt.datetime(2024, 1, 1), "w1 w2 w3")], schema), F.col("content")))
    by_joins, calls = dedup._weighed_by_joins, []
    monkeypatch.setattr(dedup, "_weighed_by_joins", lambda *a: calls.append(1) or by_joins(*a))

    def found(rows):
        return sorted(tuple(r) for r in dedup.dedup_bm25_batch(spark.createDataFrame(rows, schema), index, threshold=2.5).collect())

    packed = found(rows[:7] + rows[8:])
    assert not calls and any(not new for *_, new in packed)
    found(rows)  # r07 is stored as well
    assert calls == [1]
    monkeypatch.setattr(dedup, "WORDS_SENT", 3)
    assert found(rows[:7] + rows[8:]) == packed and calls == [1, 1]


def test_packing():
    ids, tf = np.array([0, 3, 70_000, 2**31 - 1]), np.array([1, 300, 1, 70_000])
    both = np.frombuffer(dedup._packed(ids, tf), np.uint8).reshape(4, -1).T.copy().view("<u4").astype(np.int64).reshape(2, -1)
    assert np.cumsum(both[0]).tolist() == ids.tolist() and both[1].tolist() == tf.tolist()
    assert dedup._packed(ids[:0], tf[:0]) == b""
