"""The index against plain search, and leaks against a word-by-word rule."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import fm_decontaminate as fm


@pytest.mark.parametrize("letters,n", [(1, 40), (2, 300), (5, 2000), (300, 3000)])
def test_index_counts_and_locates(letters, n):
    rng = np.random.default_rng(letters)
    text = np.append(rng.integers(1, letters + 1, n), 0)
    if letters == 5:
        text[1000:1500] = text[0:500]
    order = fm.suffix_array(text)
    if n <= 300:
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = fm.FMIndex(text, 4)
    phrases = np.array([text[i:i + 3] if i % 3 else rng.integers(1, letters + 1, 3) for i in range(0, n - 3, 7)])
    low, high = index.search(phrases, np.full(len(phrases), 3))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - 2) if (text[i:i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window):
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            b = split(t)
            for k in range(max(len(b) - window + 1, 1) if b else 0):
                p = b[k:k + window]
                for s in range(len(w) - len(p) + 1):
                    if w[s:s + len(p)] == p:
                        hit.update(range(s, s + len(p)))
                        found.add(item)
        out.append((str(i), len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    vocab = ["Aa", "bé", "c1", "Ñ", "e"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 4, 5, 9]))) for i in range(12)] + [(3, None), (None, "e e e e e"), (20, "!!"), (21, "unseen words here now")]
    items.append((22, items[5][1]))
    docs = [(i, say(rng.choice([0, 2, 5, 30, 200]))) for i in range(60)] + [(None, None), (7, "e, E! e. e e e"), (7, "e, E! e. e e e"), (8, "")]
    docs += [(100 + i, docs[3][1] + "\n" + items[4][1]) for i in range(5)]
    return docs, items


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 24), (37, 1 << 24), (64, 60)])
def test_leaks(spark, monkeypatch, shard, block):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int").repartition(2)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, _words string")
    if shard != 1 << 20:
        hashes = fm.Phrases([t for _, t in items], [None if i is None else str(i) for i, _ in items], 4)
        monkeypatch.setattr(fm, "SHARD_WORDS", shard)
        whole = fm.words(pa.array([t for _, t in docs], pa.string()), fm.ALNUM)
        inside, pairs = hashes.hits(*whole)
        got = []
        for k, (i, _) in enumerate(docs):
            a, z = whole[1][k], whole[1][k + 1]
            got.append((str(i), int(z - a), int(inside[a:z].sum()), sorted(hashes.ids[x] for t, x in pairs.tolist() if t == k)))
        assert sorted(got, key=str) == plain(docs, items, 4)
    rows = fm.find_leaks(d, b, 4, block).collect()
    got = sorted(((str(r.doc_id), r._words, sum(s.end - s.start for s in r._spans), sorted(r._items)) for r in rows), key=str)
    assert got == plain(docs, items, 4)


def test_no_rows(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert fm.find_leaks(d.limit(0), b).collect() == []
    assert all(r._spans == [] and r._items == [] for r in fm.find_leaks(d, b.limit(0)).collect())
