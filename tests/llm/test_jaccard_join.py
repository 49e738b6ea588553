"""Links and components against all pairs, at every cost of a bucket."""

import random
import re

import numpy as np
import pytest

from palimpsest.llm import jaccard_join as jj
from palimpsest.llm.common import table


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def run(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words) + 1)
        rng.choice((lambda: words.insert(at, f"n{rng.randrange(99)}"), lambda: words.pop(at % len(words)) if len(words) > 1 else None))()
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    shared = [f"p{i}" for i in range(30)]  # a passage in many documents
    for base in range(45):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((1, 3, 5, 6, 8, 9, 10, 12, 14, 20, 40, 90, 300)))]
        if base % 3 == 0:
            words[len(words) // 2:len(words) // 2] = shared
        for _ in range(rng.choice((1, 2, 6, 12))):
            out.append(" ".join(edited(rng, words, rng.choice((0, 0, 1, 1, 2, len(words) // 40, len(words) // 24)))))
    out += [None, "", " \n", "A b", "a B", "Éa é", " ".join(["again"] * 300), "İ i"] + [out[3]] * 20 + ["x " * 20000 + "y", "x " * 20000 + "y z"]
    ids = list(range(1000, 1000 + len(out)))
    rng.shuffle(ids)
    found = list(zip(ids, out))
    return found + [(None, out[3]), (None, out[40]), (None, None), (None, "only this one has no id at all"), (ids[0], "the same id for another text"), found[5], found[5]]


@pytest.mark.parametrize("costly", [jj.COSTLY, 3, 0])
def test_components(spark, rows, costly, monkeypatch):
    monkeypatch.setattr(jj, "CROWDED", 2 if costly < 9 else 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n", "'x' as bucket", "true as thin")
    assert run(jj.linked_documents(df, costly)) == plain(rows)


def test_empty(spark):
    assert run(jj.linked_documents(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert run(jj.linked_documents(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string"))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert run(jj.op11_jaccard_join(spark, "/root/testdata/sf0.001")) == plain(rows)


def linked(a, b):
    return 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))


def test_linked_sets_always_meet():
    """Any linked pair shares an index entry that neither set may leave out, or one of the second index."""
    rng = np.random.default_rng(9)
    for _ in range(3000):
        n = int(rng.choice((4, 5, 6, 7, 9, 10, 11, 16, 17, 40, 130)))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        d = int(rng.integers(0, n // 4 + 2))
        drop = int(rng.integers(0, d + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, d - drop, dtype=np.uint64)]))
        if not linked(a, b):
            continue
        met = False
        for la in (False, True):
            for lb in (False, True):
                one, _, spare_a = jj.segments(a, np.array([0, len(a)]), la)
                two, _, spare_b = jj.segments(b, np.array([0, len(b)]), lb)
                common = np.intersect1d(one, two)
                # whichever common buckets are costly, as long as one of the sets can do without them, one more is common
                if len(common) and (len(common) > spare_a[0] >= 0 or len(common) > spare_b[0] >= 0):
                    met = True
                    costly = rng.permutation(common)[:int(rng.integers(0, len(common) + 1))]
                    if spare_a[0] < len(costly) and spare_b[0] < len(costly):
                        assert len(np.intersect1d(jj.second_buckets(a, la, costly), jj.second_buckets(b, lb, costly)))
                elif spare_a[0] < 0 and spare_b[0] < 0 and jj.scheme(np.array([len(a)]), la)[0] == jj.scheme(np.array([len(b)]), lb)[0]:
                    met = True
                    none = np.empty(0, np.uint64)
                    assert len(np.intersect1d(jj.second_buckets(a, la, none), jj.second_buckets(b, lb, none)))
        assert met or np.array_equal(a, b), (len(a), len(b))


def test_sizes():
    """H is what sizes allow, for every size and partner."""
    for n in range(1, 400):
        for m in range(n, n * 5 // 4 + 1):
            apart = max(d for d in range(n + m + 1) if (n + m - d) % 2 == 0 and 100 * (n + m - d) // 2 >= 80 * ((n + m + d) // 2)) if 100 * n >= 80 * m else 0
            assert apart <= jj.most_apart(np.array([n]))[0]


def test_copies_that_are_not_linked_make_no_pairs(spark, monkeypatch):
    """Copies of one text with edits that others share, no two of them alike enough, meet in many buckets; parity bits are compared there."""
    rng, made = random.Random(4), []
    base, other = [f"w{i}" for i in range(300)], [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        edits = set(rng.sample(range(300), 12))
        texts.append(" ".join(other[i] if i in edits else base[i] for i in range(300)))
    pairs_of = jj._pairs_of

    def counted(*args):
        pairs = pairs_of(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(jj, "_pairs_of", counted)
    rows = list(enumerate(texts))
    assert run(jj.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    assert sum(made) < 60
