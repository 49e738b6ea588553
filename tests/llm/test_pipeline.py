"""The pipeline against the same decisions in plain Python, and stages on odd rows."""

import hashlib
import re
from array import array
from collections import Counter

import public_tokenizers
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from palimpsest.llm import pretokens, stages, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_groups(docs):
    bags = {}
    for i, t in docs.items():
        w = split(t)
        bags[i] = Counter(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else t
    has, group = {}, {i: i for i in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, b in bags.items():
        if isinstance(b, str):
            near = [j for j, c in bags.items() if j < i and c == b]
        else:
            near = {j for s in b for j in has.get(s, ())}
            near = [j for j in near if sum((b & bags[j]).values()) >= 0.8 * sum((b | bags[j]).values())]
            for s in b:
                has.setdefault(s, []).append(i)
        for j in near:
            a, c = sorted((root(i), root(j)))
            group[c] = a
    return {i: root(i) for i in docs}


def test_pipeline_makes_the_same_decisions(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    model = toxicity.learn(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    docs = {r.doc_id: r.text or "" for r in rows if model.of_texts(pa.array([r.text]))[0] < toxicity.THRESHOLD}
    groups = near_groups(docs)
    docs = {i: t for i, t in docs.items() if groups[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[k:k + 10]) for k in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    docs = {i: t for i, t in docs.items() if not any(tuple(w[k:k + n]) in windows for w in [split(t)] for n in sizes for k in range(len(w) - n + 1))}
    library, _ = pretokens.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.doc_id: r for r in __spark_entry__.queries()["pipeline"](spark, sf).collect()}
    assert got.keys() == docs.keys() and len(docs) < len(rows)
    for i, t in docs.items():
        ids = library.encode_ordinary(t)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_on_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    long = " ".join(f"word{i}" for i in range(60))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, long, "a", 1, "x"), (2, long + " more", "a", 1, "x"), (2, long + " more", "a", 1, "x"), (None, "nameless", None, 1, "x"), (None, "nameless", None, 1, "y"),
            (3, None, None, None, None), (4, "", "", 0, ""), (5, "before " + item + " after", "en", 1, ""), (6, "z" * 100_000, "en", 1, ""), (7, "good", "en", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string, _words int, `odd name` string")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.schema.names == docs.schema.names
        assert step(spark, docs.limit(0), sf).collect() == []
    kept = sorted(str(r.doc_id) for r in stages.drop_near_duplicates(spark, docs, sf).collect())
    assert kept == ["1", "3", "5", "6", "7", "None"]
    # near copies without an id of a document that has one, and different texts that share an id
    near = [(7, long), (None, long + " x"), (None, long + " y"), (7, "quite another text"), (8, "quite another text"), (None, "alone"), (9, None), (None, "")]
    some = spark.createDataFrame(near, "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text) for r in stages.drop_near_duplicates(spark, some, sf).collect())
    assert kept == sorted([("7", long), ("7", "quite another text"), ("None", "alone"), ("9", None)], key=lambda r: (r[0], str(r[1])))
    assert sorted(str(r.doc_id) for r in stages.drop_leaks(spark, docs, sf).collect()) == sorted(str(r[0]) for r in rows if r[0] != 5)
    assert stages.encode(spark, docs, sf).count() == len(rows) and stages.encode(spark, docs.limit(0), sf).collect() == []
