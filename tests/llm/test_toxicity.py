"""The kernel against its definition, the fit by held-out accuracy, and odd rows."""

import itertools
import zlib

import numpy as np
import pyarrow as pa

from palimpsest.llm import toxicity as tx


def coded(*texts):
    return tx.pieces(pa.array(texts, pa.string()))


def plain_subsequences(word):
    marked = [tx._BEGIN, *(ord(c) - 96 for c in word), tx._END]
    out = {}
    for places in itertools.combinations(range(len(marked)), 4):
        if places[3] - places[0] < tx.SPAN:
            key = tuple(marked[i] for i in places)
            out[key] = out.get(key, 0) + tx.DECAY ** (places[3] - places[0] + 1)
    return out


def test_kernel_is_the_gapped_subsequence_kernel():
    codes, bounds, _ = coded("moron idiot clown morsel axlotl cat m")
    words = ["".join(chr(96 + c) for c in codes[a:b]) for a, b in bounds]
    marks = tx.Landmarks(codes, bounds)
    got = tx.kernel_to(codes, bounds, marks)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = plain_subsequences(a), plain_subsequences(b)
            want = sum(v * y.get(k, 0) for k, v in x.items()) / tx.norms()[len(a) + 2] / tx.norms()[len(b) + 2]
            assert abs(got[i, j] - want) < 1e-4
    projected = got @ marks.map
    assert np.allclose(projected @ projected.T, got, atol=1e-3)
    beta = np.arange(projected.shape[1], dtype=float)
    assert np.allclose(tx.scores(codes, bounds, marks.weights(beta)), projected @ beta, rtol=1e-2, atol=1e-2)


def test_pieces_see_through_signs_and_gaps():
    for text in ("moron", "m.o.r.o.n!", "M o r o n", "m0ron", "m\u200bor-on"):
        codes, bounds, _ = coded(text)
        assert "".join(chr(96 + c) for c in codes[slice(*bounds[0])]) == "moron", text
    codes, bounds, occurrences = coded("x" * 100, None, "", "a bc a bc", "!?")
    assert sorted(set(occurrences[:, 1].tolist())) == [0, 3] and (bounds[:, 1] - bounds[:, 0]).max() <= tx.PIECE


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in tx.op7_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(t == p for t, p in held) >= 0.98 * len(held)
    assert sum(t and p for t, p in held) >= 0.9 * sum(t for t, _ in held)
    short = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 100").collect()}
    clean = [r.doc_id for r in labels if r.toxic == 0 and r.doc_id in short]
    assert sum(got[i].predicted for i in clean) <= 0.02 * len(clean)
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_odd_rows(spark):
    insult = ["you moron", "such trash and scum", "what a m.o.r.o.n he is", "trash"]
    fine = ["the tree is green", "we went for a walk", "more rain today", "a clean street and a house"]
    rows = [(i, f"{(insult if i % 2 else fine)[i // 2 % 4]} and thing{i % 37} too", "x") for i in range(160)]
    rows += [(None, "no id", ""), (500, None, ""), (501, "", ""), (502, "z" * 50_000, ""), (503, "!? ..", ""), (504, "a moron and trash", ""), (504, "a moron and trash", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(160)] + [(None, 1, 1), (3, None, 1), (500, 0, 1), (999, 1, 1)], "doc_id long, toxic int, quality int")
    model = tx.learn(docs, labels, 60)
    got = tx.score_documents(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r._score for r in got}
    assert by_id[504] > 0.5 > max(by_id[i] for i in (500, 501, 502, 503))
    assert tx.score_documents(docs.limit(0), model).collect() == []
    silent = tx.learn(docs, labels.limit(0))
    assert {r._score for r in tx.score_documents(docs, silent).collect()} == {0.0}


def test_repeated_rows_weigh_once(spark):
    rows = [(i, f"{'you moron' if i % 2 else 'the tree is green'} and thing{i % 37} too") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    many = docs.union(docs.filter("doc_id in (5, 8, 13)").crossJoin(spark.range(300)).select("doc_id", "text"))
    once, often = tx.learn(docs, labels), tx.learn(many, labels)
    assert np.array_equal(once.weights, often.weights) and once.bias == often.bias and np.array_equal(once.scale, often.scale)
