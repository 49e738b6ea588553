"""Signatures against exact likeness, classes against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import dart_minhash as dm

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def likeness(a, b):
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 0.0


def test_collisions_follow_the_weighted_likeness():
    rng = np.random.default_rng(3)
    sets, wants = [], []
    for size, common in ((5, 4), (40, 30), (400, 100), (3000, 2700)):
        base = rng.integers(0, 2**63, size, np.int64).astype(np.uint64)
        base[size // 2:size // 2 + size // 10] = base[0]
        other = base.copy()
        other[common:] = rng.integers(0, 2**63, size - common, np.int64).astype(np.uint64)
        sets += [base, other]
        wants.append(likeness(Counter(base.tolist()), Counter(other.tolist())))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets]), [sum(map(len, sets))]])
    signatures = dm.dart_signatures(dm.weighted(np.concatenate(sets), offsets), offsets, 4000)
    assert (signatures[-1] == dm._EMPTY).all() and (signatures[:-1] != dm._EMPTY).all()
    for i, want in enumerate(wants):
        assert abs((signatures[2 * i] == signatures[2 * i + 1]).mean() - want) < 0.04
    alone = dm.dart_signatures(dm.weighted(sets[2], np.array([0, len(sets[2])])), np.array([0, len(sets[2])]), 4000)
    assert (alone[0] == signatures[2]).all()


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = []
    for g in range(25):
        base = say(rng.choice([4, 12, 60, 150, 400]))
        docs.append(base)
        for _ in range(rng.choice([0, 1, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(w)
    passage = say(80)
    docs += [say(20) + passage + say(rng.randrange(5, 40)) for _ in range(30)]
    chain = say(200)
    for _ in range(12):  # neighbours are alike, the ends are not
        chain = chain[8:] + say(8)
        docs.append(chain)
    docs += [["again"] * 300, ["again"] * 290, ["again"] * 100, say(7000)]
    docs.append(docs[-1][:6990])
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    copies = rng.choice(docs[:5])
    rows += [(1000 + i, ("  ".join(copies)).upper() if i % 2 else " ".join(copies)) for i in range(60)]
    rows += [(5000, None), (5001, ""), (5002, "!!"), (5003, "!!"), (5004, "one"), (5005, "One."), (5004, "one"), (6000, " ".join(docs[-1]))]
    return rows


def classes(rows):
    bags = [bag(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0] and rows[i][0] is not None
            plain = not bags[i] and not bags[j] and (rows[i][1] or "") == (rows[j][1] or "")
            if same or plain or (bags[i] and bags[j] and likeness(bags[i], bags[j]) >= dm.SIMILAR):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, 2**63), d if d is not None else 2**63)
    return [(d, least[root(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("bound", [dm.BROADCAST_ROWS, 0])
def test_classes(spark, monkeypatch, bound):
    monkeypatch.setattr(dm, "BROADCAST_ROWS", bound)
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string").repartition(5)
    got = sorted((r.doc_id, r.class_id) for r in dm.near_duplicates(df).collect())
    assert got == sorted(classes(rows))


def test_no_ids_and_no_rows(spark):
    long = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(None, long), (None, long), (None, long + " more"), (4, "else"), (None, None)], "doc_id long, text string")
    got = [(r.doc_id, r.class_id) for r in dm.near_duplicates(df).collect()]
    assert len({c for d, c in got}) == 3 and all(c >= 2**62 for d, c in got if d is None)
    assert dm.near_duplicates(df.limit(0)).collect() == []


def test_near_copies_take_few_checks(spark, monkeypatch):
    rng, checked, seen = random.Random(5), dm.checked, []
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    docs = [base]
    for _ in range(150):  # alike to the base, seldom to each other
        copy = list(base)
        for at in rng.sample(range(200), 4):
            copy[at] = f"x{rng.randrange(10**6)}"
        docs.append(copy)
    ids = rng.sample(range(10**6), len(docs))
    monkeypatch.setattr(dm, "checked", lambda pairs, items: (seen.append(pairs.count()), checked(pairs, items))[1])
    rows = [(i, " ".join(w)) for i, w in zip(ids, docs)]
    got = sorted((r.doc_id, r.class_id) for r in dm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(classes(rows)) and len({c for _, c in got}) < len(docs)
    assert sum(seen) < 3 * len(docs)
