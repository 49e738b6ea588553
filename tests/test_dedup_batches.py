"""New rows against stored ones and each other: by vector, by keywords, and along hot keys."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest

from palimpsest.operators import bm25, dedup, vectors
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(hours=24)


def cos(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6) if np.any(a) and np.any(b) else 0.0


def vector_rows(seed, n, prefix, spread):
    rng = np.random.default_rng(seed)
    base = np.random.default_rng(1).normal(size=(8, 5))
    out = []
    for i in range(n):
        v = base[rng.integers(8)] + spread * rng.normal(size=5)
        out.append((f"{prefix}{i:03d}", ("ann", "bob", None)[int(rng.integers(3))], T0 + dt.timedelta(hours=int(rng.integers(24 * 4))), [float(np.float32(x)) for x in v]))
    return out + [(f"{prefix}zero", "ann", T0, [0.0] * 5), (f"{prefix}null", "ann", T0, None)]


def brute_semantic(rows, stored, threshold):
    """Row by row in order of time and id; stored rows come before new ones of their time."""
    kept = [(t, True, i, u or "", v) for i, u, t, v in stored if v is not None and any(v)]
    out, order = {}, sorted(rows, key=lambda r: (r[2], r[0]))
    for i, u, t, v in order:
        near = [(-cos(v, w), -s.timestamp(), j) for s, _, j, o, w in kept if v is not None and o == (u or "") and s <= t and t - s < DAY and cos(v, w) >= threshold]
        if near:
            out[i] = min(near)[2]
        else:
            out[i] = i
            if v is not None and any(v):
                kept.append((t, False, i, u or "", v))
    return out


@pytest.mark.parametrize("chunk", [7, 8192])
def test_semantic_against_stored(spark, chunk):
    schema = "uuid string, user_id string, created_at timestamp, content_embedding array<float>"
    rows, stored = vector_rows(2, 150, "r", 0.3), vector_rows(3, 40, "s", 0.3)
    got = dedup.dedup_semantic(spark.createDataFrame(rows, schema), existing=spark.createDataFrame(stored, schema), threshold=0.93, chunk_rows=chunk)
    got = {r.input_id: r.canonical_uuid for r in got.collect()}
    assert got == brute_semantic(rows, stored, 0.93)
    assert any(k.startswith("s") for k in got.values()) and any(k.startswith("r") and k != i for i, k in got.items())


def brute_keywords(rows, stored, threshold):
    docs = [(i, u or "", t, c.lower().split()) for i, u, t, c in stored + rows]
    n, average = len(docs), sum(len(d[3]) for d in docs) / len(docs)
    df = Counter(w for d in docs for w in set(d[3]))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}

    def score(query, doc):
        tf = Counter(doc)
        return round(sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(doc) / average)) for w in query if w in tf), 6)

    kept, out = [(t, i, u or "", c, True) for i, u, t, c in stored], {}
    for i, u, t, c in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = [(s, j) for s, j, o, d, old in kept if o == (u or "") and (s, j) < (t, i) and t - s < DAY
                and (not old and d == c or score(c.lower().split(), d.lower().split()) >= threshold)]
        if mine:
            newest = max(s for s, _ in mine)
            out[i] = min(j for s, j in mine if s == newest)
        else:
            out[i] = i
            kept.append((t, i, u or "", c, False))
    return out


@pytest.mark.parametrize("threshold", [0.7, 4.0])
def test_keywords_inside_a_batch(spark, threshold):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(80)]

    def some(n, prefix):
        return [(f"{prefix}{k:03d}", rng.choice(("ann", "bob", None)), T0 + dt.timedelta(hours=rng.randrange(72)),
                 " ".join(rng.choices(words, k=rng.choice((1, 2, 4, 6))))) for k in range(n)]

    rows, stored = some(90, "r"), some(25, "s")
    rows += [("x1", "ann", T0 + dt.timedelta(hours=80), "Book a flight to Rome"), ("x2", "ann", T0 + dt.timedelta(hours=81), "Book a flight to Rome"),
             ("x3", "bob", T0 + dt.timedelta(hours=81), "Book a flight to Rome"), ("x4", "ann", T0 + dt.timedelta(hours=110), "Book a flight to Rome"), ("x5", "ann", T0, "")]
    schema = "uuid string, user_id string, created_at timestamp, content string"
    index = bm25.build(bm25.documents(spark.createDataFrame(stored, schema), F.col("content")))
    got = {r.input_id: r.canonical_uuid for r in dedup.dedup_bm25_batch(spark.createDataFrame(rows, schema), index, threshold=threshold).collect()}
    assert got == brute_keywords(rows, stored, threshold)
    assert got["x2"] == "x1" and got["x3"] == "x3" and got["x4"] == "x4" and got["x5"] == "x5"


@pytest.mark.parametrize("matches", [1, 40])
def test_keywords_in_small_steps(spark, monkeypatch, matches):
    """Chunks of a few documents and words, steps of a few matches, and windows with more than a step holds."""
    rng = random.Random(7)
    rows, stored = ([(f"{x}{k:02d}", rng.choice(("ann", "bob")), T0 + dt.timedelta(hours=rng.randrange(96)), " ".join(rng.choices("abcdefghijklmnopqrst", k=3)))
                     for k in range(n)] for x, n in (("r", 70), ("s", 10)))
    for name, value in (("MATCHES", matches), ("SIDE", 6), ("WORDS", 4)):
        monkeypatch.setattr(dedup, name, value)
    schema = "uuid string, user_id string, created_at timestamp, content string"
    index = bm25.build(bm25.documents(spark.createDataFrame(stored, schema), F.col("content")))
    got = {r.input_id: r.canonical_uuid for r in dedup.dedup_bm25_batch(spark.createDataFrame(rows, schema), index, threshold=2.0).collect()}
    assert got == brute_keywords(rows, stored, 2.0)


def test_keywords_of_an_empty_batch(spark):
    schema = "uuid string, user_id string, created_at timestamp, content string"
    none = spark.createDataFrame([], schema)
    index = bm25.build(bm25.documents(spark.createDataFrame([("s", "ann", T0, "one text")], schema), F.col("content")))
    assert dedup.dedup_bm25_batch(none, index).collect() == []
    alone = spark.createDataFrame([("r", "ann", T0, "one text")], schema)
    assert [tuple(r) for r in dedup.dedup_bm25_batch(alone, bm25.build(bm25.documents(none, F.col("content")))).collect()] == [("r", "r", True)]


def test_following_times(spark):
    """The next time a window later, with many cells empty and times on their borders."""
    rng = random.Random(8)
    width = 640
    times = {k: sorted({rng.randrange(20_000) for _ in range(n)} | {0, 640, 641}) for k, n in (("a", 200), ("b", 5), ("c", 0))}
    rows = [(k, t) for k, ts in times.items() for t in ts]
    got = {(r.k, r.t): r.nxt for r in dedup._following(spark.createDataFrame(rows, "k string, t long"), ["k"], width).collect()}
    assert got == {(k, t): min((x for x in ts if x >= t + width), default=None) for k, ts in times.items() for t in ts}


@pytest.mark.parametrize("best", [True, False])
def test_sparse_windows_are_walked_in_chunks(spark, monkeypatch, best):
    monkeypatch.setattr(vectors, "_greedy_rounds", None)  # would be one small group for every window
    rng = np.random.default_rng(8)
    rows = [(f"r{i:03d}", "ann" if i % 3 else "bob", T0 + dt.timedelta(minutes=int(rng.integers(0, 24 * 60 * 30))), rng.normal(size=4).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, user_id string, t timestamp, vec array<double>")
    got = {r.id: (r.keeper, r.score) for r in vectors.greedy_keep(df, block=["user_id"], ident="id", ts="t", vector="vec", threshold=0.6, window_hours=24, best=best, chunk_rows=30).collect()}
    kept, want = [], {}
    for i, u, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        near = [(-cos(v, w) if best else 0, -s.timestamp() if best else n, j) for n, (j, o, s, w) in enumerate(kept) if o == u and t - s < DAY and cos(v, w) >= 0.6]
        want[i] = (min(near)[2] if near else i)
        if not near:
            kept.append((i, u, t, v))
    assert {i: k for i, (k, _) in got.items()} == want and 30 < len(kept) < 290
