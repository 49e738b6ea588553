"""The model against a plain count of everything, and a sum over all words that must be one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import kneser_ney as kn
from palimpsest.llm.common import mix


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


class Plain:
    def __init__(self, texts):
        self.words, self.pairs, self.texts = Counter(), Counter(), len(texts)
        for t in texts:
            w = split(t)
            self.words.update(w)
            self.pairs.update(zip(["\t", *w], w))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.times = Counter(b for _, b in self.pairs)
        self.follow = {}
        for (a, _), n in self.pairs.items():
            self.follow.setdefault(a, Counter())[min(n, 3)] += 1
        self.pd = kn.discounts([sum(n == k for n in self.pairs.values()) for k in range(1, 5)])
        self.wd = kn.discounts([sum(n == k for n in self.times.values()) for k in range(1, 5)])

    def lower(self, w):
        kinds, t = len(self.pairs), self.times[w]
        uniform = 1 / (self.v + 1)
        if not kinds:
            return uniform
        mass = sum(self.wd[min(n, 3) - 1] for n in self.times.values())
        return (max(t - self.wd[min(t, 3) - 1], 0) if t else 0) / kinds + mass / kinds * uniform

    def p(self, a, b):
        total = self.texts if a == "\t" else self.words[a]
        if not total:
            return self.lower(b)
        n = self.pairs[a, b]
        mass = sum(self.pd[k - 1] * c for k, c in self.follow[a].items())
        return (max(n - self.pd[min(n, 3) - 1], 0) if n else 0) / total + mass / total * self.lower(b)

    def of(self, text):
        w = split(text)
        base = sum(math.log10((self.words[x] + 1) / (self.n + self.v + 1)) for x in w)
        return len(w), sum(self.words[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(a, b)) for a, b in zip(["\t", *w], w))


def corpus():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)] + ["É", "AB", "ab", "a b"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocab, weights, k=rng.choice([0, 1, 3, 30, 200]))), "x") for i in range(150)]
    return rows + [(None, "no id at all", ""), (500, None, ""), (501, " \t\n", ""), (7, "again Again", ""), (7, "again Again", ""), (502, "same " * 3000, "")]


@pytest.mark.parametrize("together", [kn.TOGETHER, 40])
def test_scores(spark, monkeypatch, together):
    monkeypatch.setattr(kn, "TOGETHER", together)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    model = kn.train(docs.filter(~kn.held_out(docs.doc_id)))
    plain = Plain([t for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2])
    assert (model.tokens, model.words, model.kinds) == (plain.n, plain.v, len(plain.pairs))
    got = sorted(map(tuple, kn.score_texts(docs, model).collect()), key=str)
    want = sorted(((i, *plain.of(t)) for i, t, _ in rows), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)
    for a in ("\t", "w0", "w200", "never"):
        assert sum(plain.p(a, b) for b in [*plain.words, "unknown"]) == pytest.approx(1)


def test_nothing_to_learn_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = kn.train(docs.limit(0))
    assert model.tokens == 0
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in kn.score_texts(docs, model).collect())
    assert kn.score_texts(docs.limit(0), model).collect() == []


def test_unmix():
    x = np.random.default_rng(0).integers(0, 2**63, 1000, np.int64).astype(np.uint64) * np.uint64(2)
    assert (kn.unmix(mix(x)) == x).all()


def test_held_out_documents_are_likelier_than_by_the_base(spark):
    rows = kn.op9_kneser_ney(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
