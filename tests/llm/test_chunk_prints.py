"""Chunks against a byte-by-byte rule, the ring of documents against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import chunk_prints as cp


def plain_chunks(data: bytes):
    out, at = [], 0
    h = [0] * len(data)
    for i in range(len(data)):
        h[i] = sum(int(cp.GEAR[data[i - k]]) << k for k in range(16) if i - k >= 0) & 0xFFFF
    while at < len(data):
        end = min(at + cp.MOST, len(data))
        for i in range(at + cp.LEAST, end):
            mask = int(cp.RARE) if i - at < cp.USUAL else int(cp.FREQUENT)
            if h[i - 1] & mask == 0:
                end = i
                break
        out.append(data[at:end])
        at = end
    return out


def text(rng, n):
    return "".join(rng.choice("abcdefgh éñ\n") for _ in range(n))


def test_chunks():
    rng = random.Random(1)
    texts = [text(rng, n).encode() for n in (0, 1, 15, 16, 17, 200, 0, 3000, 128, 129)] + [b"a" * 1000, b""]
    starts, ends = cp.chunk_ends(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    whole = b"".join(texts)
    assert [whole[a:b] for a, b in zip(starts, ends)] == [c for t in texts for c in plain_chunks(t)]
    for t, f in zip(texts, cp.fingerprints(texts)):
        assert sorted(f.values()) == sorted(map(len, set(plain_chunks(t))))
    moved = cp.fingerprints([texts[7], b"in front " + texts[7]])
    assert cp.containment(*moved) > 0.9 and cp.containment({}, {}) == 1 and cp.containment({}, moved[0]) == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ring(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 7 % 101, text(rng, rng.choice([0, 1, 5, 300, 2000])), 1) for i in range(80)]
    rows += [(500, None, 2), (3000, "same text " * 9, 1), (3001, "same text " * 9, 1), (3001, "same text " * 9, 1), (3001, "other", 0), (None, "no id " * 20, 0), (None, "x", 0)]
    df = spark.createDataFrame([(a, b, c) for a, b, c in rows], "doc_id long, text string, fingerprint int").repartition(4)
    got = sorted(map(tuple, cp.fingerprint_rows(df, parts).collect()), key=str)
    ring = sorted(((a, b or "") for a, b, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for (i, t), (_, n) in zip(ring, [*ring[1:], ring[0]]):
        e = cp.edited(t, n)
        f, g, h = cp.fingerprints([t.encode(), e.encode(), n.encode()])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), cp.spelled(f), cp.spelled(g), cp.containment(f, g), cp.containment(f, h)))
    assert got == sorted(want, key=str)


def test_no_rows_and_one(spark):
    df = spark.createDataFrame([(1, "only one document here, rather short")], "doc_id int, text string")
    assert cp.fingerprint_rows(df.limit(0)).collect() == []
    row = cp.fingerprint_rows(df).first()
    assert row.near_next == 1.0 and row.doc_id == 1
