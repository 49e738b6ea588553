"""Communities by modularity against plain Python and against label propagation."""

import itertools
import random
from collections import Counter

import pytest

from palimpsest.operators import community
from palimpsest.operators.louvain import louvain, quality, weighted_adjacency


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in pairs], "source_uuid string, target_uuid string, w double")


def modularity(pairs, label, resolution=1.0):
    """Every edge looked at from both ends."""
    w = Counter()
    for a, b, x in pairs:
        if a != b:
            w[frozenset((a, b))] += x
    total = 2 * sum(w.values())
    inside, degree = Counter(), Counter()
    for pair, x in w.items():
        a, b = pair
        degree[label[a]] += x
        degree[label[b]] += x
        if label[a] == label[b]:
            inside[label[a]] += 2 * x
    return sum(inside[c] / total - resolution * (degree[c] / total) ** 2 for c in degree)


def best_split(pairs, resolution=1.0):
    """The largest modularity of any labelling of a small graph."""
    nodes = sorted({x for a, b, _ in pairs for x in (a, b)})

    def splits(i, used):
        if i == len(nodes):
            yield ()
            return
        for c in range(used + 1):
            for rest in splits(i + 1, max(used, c + 1)):
                yield (c, *rest)

    return max(modularity(pairs, dict(zip(nodes, s)), resolution) for s in splits(0, 0))


def found(df):
    return {r["uuid"]: r["community"] for r in df.collect()}


def test_two_triangles(spark):
    pairs = [(a, b, 1) for t in ("abc", "xyz") for a, b in itertools.combinations(t, 2)] + [("c", "x", 1)]
    assert found(louvain(graph(spark, pairs))) == {**dict.fromkeys("abc", "a"), **dict.fromkeys("xyz", "x")}
    assert set(found(louvain(graph(spark, pairs), min_community_size=4))) == set()
    assert len(set(found(louvain(graph(spark, pairs), resolution=8.0)).values())) > 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_small_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdefgh"
    pairs = [(a, b, rng.choice((1, 1, 3))) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.4]
    pairs += [pairs[0], ("a", "a", 5)]
    label = found(louvain(graph(spark, pairs), weight="w"))
    assert set(label) == {x for a, b, _ in pairs if a != b for x in (a, b)}
    assert all(c == min(u for u in label if label[u] == c) for c in label.values())
    assert modularity(pairs, label) >= 0.9 * best_split(pairs) - 1e-9


def test_planted_communities_and_quality(spark):
    rng = random.Random(4)
    group = {f"n{i:03d}": i % 8 for i in range(160)}
    pairs = [(a, b, 1) for a, b in itertools.combinations(sorted(group), 2) if rng.random() < (0.5 if group[a] == group[b] else 0.02)]
    edges = graph(spark, pairs)
    label = found(louvain(edges))
    assert modularity(pairs, label) >= modularity(pairs, group) - 1e-9
    adj = weighted_adjacency(edges)
    total = float(2 * len(pairs))
    mine = louvain(edges).withColumnRenamed("community", "label")
    assert quality(adj, mine, total) == pytest.approx(modularity(pairs, label))
    assert quality(adj, mine, total) >= quality(adj, community.label_propagation(edges), total)


def test_no_edges(spark):
    assert found(louvain(graph(spark, []))) == {}
    assert found(louvain(graph(spark, [("a", "a", 1)]))) == {}
