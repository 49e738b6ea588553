"""Operators against brute force, with limits set so low that the paths for hot keys run."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import bm25, community, dedup, joins, matching, skew, vectors

T0 = dt.datetime(2024, 1, 1)


def unit(rng, n, d=6):
    m = rng.normal(size=(n, d))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def cos(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return round(float(a @ b / (na * nb)), 6) if na and nb else 0.0


# ---- exact de-duplication -----------------------------------------------------------------------

def brute_dedup(rows, hours=24, existing=()):
    """rows: (key, id, t); existing rows are kept already."""
    out, width = {}, dt.timedelta(hours=hours)
    for key in {r[0] for r in rows}:
        stored = sorted((t, i) for k, i, t in existing if k == key)
        kept = []
        for t, i in sorted((t, i) for k, i, t in rows if k == key):
            near = [(a, j) for a, j in stored + kept if a <= t and t - a < width]
            if near:
                out[i] = max(near, key=lambda x: (x[0], x in stored))[1]
            else:
                kept.append((t, i))
                out[i] = i
    return out


@pytest.mark.parametrize("hot_rows", [1, 5, 1_000_000])
def test_dedup_within_equals_row_by_row(spark, hot_rows):
    rng = random.Random(7)
    rows = [(f"k{min(rng.randrange(6), 2)}", f"r{i:04d}", T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 9)))
            for i in range(400)]
    rows += [("k0", f"same{i}", T0 + dt.timedelta(days=3)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, uuid string, created_at timestamp")
    got = {r.input_id: r.canonical_uuid for r in dedup.dedup_within(
        df, keys=["k"], ts="created_at", ident="uuid", hot_rows=hot_rows).collect()}
    assert got == brute_dedup(rows)


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_dedup_respects_stored_rows(spark, hot_rows):
    rng = random.Random(3)
    rows = [("k", f"r{i:03d}", T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 6))) for i in range(80)]
    old = [("k", f"old{i}", T0 + dt.timedelta(hours=30 * i)) for i in range(4)]
    schema = "k string, uuid string, created_at timestamp"
    got = {r.input_id: r.canonical_uuid for r in dedup.dedup_within(
        spark.createDataFrame(rows, schema), keys=["k"], ts="created_at", ident="uuid", hot_rows=hot_rows,
        existing=spark.createDataFrame(old, schema)).collect()}
    assert got == brute_dedup(rows, existing=old)


def test_dedup_is_idempotent(spark):
    rows = [("k", f"r{i}", T0 + dt.timedelta(hours=7 * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, uuid string, created_at timestamp")
    once = dedup.dedup_within(df, keys=["k"], ts="created_at", ident="uuid").filter("is_new")
    kept = df.join(once.select(F.col("input_id").alias("uuid")), "uuid")
    again = dedup.dedup_within(kept, keys=["k"], ts="created_at", ident="uuid")
    assert again.filter("NOT is_new").isEmpty()


# ---- greedy thinning ----------------------------------------------------------------------------

def brute_greedy(rows, threshold, hours, best):
    out = {}
    for block in {r[0] for r in rows}:
        kept = []
        for _, i, t, v in sorted((r for r in rows if r[0] == block), key=lambda r: (r[2], r[1])):
            near = [(cos(v, w), s, j) for s, j, w in kept
                    if (hours is None or t - s < dt.timedelta(hours=hours)) and cos(v, w) >= threshold]
            if near:
                pick = min(near, key=lambda x: (-x[0], -x[1].timestamp(), x[2])) if best else min(near, key=lambda x: (x[1], x[2]))
                out[i] = pick[2]
            else:
                kept.append((t, i, v))
                out[i] = i
    return out


@pytest.mark.parametrize("hours,best", [(24, True), (None, False)])
@pytest.mark.parametrize("chunk", [7, 8192])
def test_greedy_keep_equals_row_by_row(spark, chunk, hours, best):
    rng = np.random.default_rng(5)
    base = unit(rng, 12)
    rows = []
    for i in range(160):
        v = base[rng.integers(12)] if i % 3 else base[0]
        if i % 4 == 1:
            v = v + 0.3 * unit(rng, 1)[0]
        # Whole hours give equal times; block a holds most rows.
        rows.append(("a" if i % 5 else f"b{i % 3}", f"r{i:03d}", T0 + dt.timedelta(hours=int(rng.integers(24 * 5))), [float(np.float32(x)) for x in v]))
    rows.append(("a", "zero", T0, [0.0] * 6))
    df = spark.createDataFrame(rows, "g string, uuid string, created_at timestamp, vec array<float>")
    got = {r.id: r.keeper for r in vectors.greedy_keep(
        df, block=["g"], ident="uuid", ts="created_at", vector="vec", threshold=0.9, window_hours=hours, best=best,
        chunk_rows=chunk).collect()}
    assert got == brute_greedy(rows, 0.9, hours, best)


# ---- cosine -------------------------------------------------------------------------------------

@pytest.mark.parametrize("max_queries", [1, 2048])
@pytest.mark.parametrize("limit", [3, None])
def test_similarity_topk_both_routes(spark, max_queries, limit):
    rng = np.random.default_rng(1)
    cv, qv = unit(rng, 120), unit(rng, 9)
    cv[5:25] = cv[4]  # many equal vectors: ties by time, then id
    corpus = [(f"c{i:03d}", [float(x) for x in cv[i]], f"u{i % 3}", T0 + dt.timedelta(hours=i % 7)) for i in range(120)]
    queries = [(i, [float(x) for x in qv[i]], None if i % 2 else f"u{i % 3}") for i in range(9)] + [(99, None, None)]
    got = vectors.similarity_topk(
        spark.createDataFrame(corpus, "uuid string, vec array<float>, user_id string, created_at timestamp"),
        spark.createDataFrame(queries, "query_id long, embedding array<float>, user_id string"),
        vector="vec", threshold=0.2, limit=limit, max_queries=max_queries, chunk_rows=11).collect()
    want = set()
    for q, v, u in queries:
        hits = [(-cos(v, w), -t.timestamp(), i) for i, w, owner, t in corpus
                if v is not None and (u is None or u == owner) and cos(v, w) >= 0.2]
        want |= {(q, h[2], -h[0]) for h in sorted(hits)[:limit]}
    assert {(r.query_id, r.uuid, r.score) for r in got} == want


@pytest.mark.parametrize("chunk", [3, 8192])
def test_nearest_in_block(spark, chunk):
    rng = np.random.default_rng(2)
    a, b = unit(rng, 30), unit(rng, 40)
    left = [("x" if i % 2 else "y", f"l{i}", [float(v) for v in a[i]]) for i in range(30)]
    right = [("x" if i % 3 else "z", f"r{i:02d}", [float(v) for v in b[i]]) for i in range(40)]
    schema = "g string, id string, vec array<double>"
    got = vectors.nearest_in_block(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"],
                                   threshold=0.3, chunk_rows=chunk).collect()
    want = {}
    for g, i, v in left:
        hits = sorted((-cos(v, w), j) for h, j, w in right if h == g and cos(v, w) >= 0.3)
        if hits:
            want[i] = hits[0][1]
    assert {r.id: r.other for r in got} == want


# ---- joins --------------------------------------------------------------------------------------

def test_split_hot_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(60)], "k string, v int")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", str(i)) for i in range(0, 60, 6)], "k string, w string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, skew.split_hot_join(left, right, ["k"], how, hot_rows=10).collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)


@pytest.mark.parametrize("direction", ["previous", "next"])
def test_neighbor(spark, direction):
    rng = random.Random(11)
    rows = [(f"k{rng.randrange(2)}", i, T0 + dt.timedelta(microseconds=rng.choice([0, 1, 999_999, 1_000_000, 3_600_000_000, 90_000_000_000, 400_000_000_000]) + rng.randrange(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, id long, t timestamp")
    got = {r.id: (r.other.id if r.other else None) for r in joins.neighbor(df, keys=["k"], ts="t", ident="id", direction=direction).collect()}
    want = {}
    for k in ("k0", "k1"):
        order = [i for _, i in sorted((t, i) for kk, i, t in rows if kk == k)]
        for n, i in enumerate(order):
            m = n - 1 if direction == "previous" else n + 1
            want[i] = order[m] if 0 <= m < len(order) else None
    assert got == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)]
    edges += [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)]  # a long path
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    lone = {n for n in parent if all(a == b for a, b in edges if n in (a, b))}
    got = community.connected_components(spark.createDataFrame(edges, "source_uuid string, target_uuid string")).collect()
    assert {r.uuid: r.component for r in got} == {n: root(n) for n in parent if n not in lone}


# ---- keyword ------------------------------------------------------------------------------------

def brute_bm25(docs, query):
    import math
    toks = {i: t.lower().split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for ts in toks.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for i, ts in toks.items():
        s = sum(idf[q] * ts.count(q) * 2.5 / (ts.count(q) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for q in query.lower().split() if q in idf)
        out[i] = round(s, 6)
    return out


@pytest.mark.parametrize("small", [True, False])
def test_bm25_formula_and_increment(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(bm25, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    words = "alpha beta gamma delta eps the the the a".split()
    docs = {f"d{i}": " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for i in range(40)}
    queries = [(0, "the alpha alpha zzz"), (1, "GAMMA delta"), (2, "")]
    df = spark.createDataFrame([(i, "u", T0, t) for i, t in docs.items()], "uuid string, user_id string, created_at timestamp, text string")
    q = spark.createDataFrame([(i, t, None) for i, t in queries], "query_id long, text string, user_id string")
    half = df.filter("uuid < 'd2'"), df.filter("uuid >= 'd2'")
    whole = bm25.build(bm25.documents(df, F.col("text")))
    grown = bm25.build(bm25.documents(half[0], F.col("text"))).add(bm25.build(bm25.documents(half[1], F.col("text"))))
    for index in (whole, grown):
        got = {(r.query_id, r.uuid): r.score for r in bm25.score(index, q).collect()}
        for qid, text in queries:
            for i, s in brute_bm25(docs, text).items():
                assert got.get((qid, i), 0.0) == pytest.approx(s, abs=2e-6)


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "u", T0, "red fox"), ("b", "u", T0, "blue fox den"), ("c", "u", T0, "grey cat")], "uuid string, user_id string, created_at timestamp, text string")
    bm25.build(bm25.documents(df, F.col("text"))).save(str(tmp_path))
    q = spark.createDataFrame([(1, "den", None)], "query_id long, text string, user_id string")
    assert [r.uuid for r in bm25.search(bm25.Bm25Index.load(spark, str(tmp_path)), q).collect()] == ["b"]


@pytest.mark.parametrize("bound", [0, 100_000])
@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_workflow_match_equals_all_pairs(spark, threshold, bound, monkeypatch):
    monkeypatch.setattr(matching, "BROADCAST_ROWS", bound)
    rng = random.Random(21)
    words = [f"word{i}" for i in range(14)] + ["the", "of"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
    flows = [(i, text()) for i in range(25)] + [(100, "the of")]
    queries = [(i, text()) for i in range(60)] + [(500, flows[3][1]), (501, ""), (502, "a b")]
    got = {r.query_id: (r.workflow_id, r.similarity) for r in matching.workflow_match(
        spark.createDataFrame(queries, "id long, text string"), spark.createDataFrame(flows, "id long, text string"),
        threshold=threshold).collect()}
    want = {}
    for qid, qt in queries:
        q = [w for w in qt.lower().split() if len(w) > 2]
        best = None
        for fid, ft in flows:
            p = [w for w in ft.lower().split() if len(w) > 2]
            if not q or not p:
                continue
            s = round(sum(w in p for w in q) / max(len(q), len(p)), 6)
            if s >= threshold and (best is None or s > best[1]):
                best = (fid, s)
        if best:
            want[qid] = best
    assert got == want


@pytest.mark.parametrize("bound", [0, 100_000])
def test_upsert_routes(spark, bound, monkeypatch):
    from palimpsest.operators import upserts
    monkeypatch.setattr(upserts, "BROADCAST_ROWS", bound)
    schema = "uuid string, name string, summary string, mentions long, created_at timestamp, name_embedding array<double>"
    old = spark.createDataFrame([("a", "A", "s", 2, T0, [1.0]), ("b", "B", "s", 1, T0, None)], schema)
    new = spark.createDataFrame([("a", "A1", "t1", 1, T0, None), ("a", "A2", "t2", 1, T0 + dt.timedelta(days=1), None),
                                 ("c", "C", "u", 1, T0, [2.0])], schema)
    got = {r.uuid: (r.name, r.summary, r.mentions, r.name_embedding) for r in upserts.upsert_entities(old, new).collect()}
    assert got == {"a": ("A", "t2", 4, [1.0]), "b": ("B", "s", 1, None), "c": ("C", "u", 1, [2.0])}


def test_bounded_workflows_move_no_texts(spark):
    said = spark.createDataFrame([(1, "red fox den"), (2, None), (3, "blue")], "id long, text string")
    known = spark.createDataFrame([(7, "red fox"), (5, "fox red"), (9, "den")], "id long, text string")
    got = matching.workflow_match(said, known, threshold=0.3)
    assert [tuple(r) for r in got.collect()] == [(1, 5, 0.666667)]
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
