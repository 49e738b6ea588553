"""Louvain with labels as arrays: few tables are written, hubs fill several blocks, and both ways find planted communities."""

import itertools
import random

import pytest

from palimpsest.operators import louvain as by, louvain_arrays
from tests.test_louvain import found, graph, modularity


def planted():
    rng = random.Random(7)
    group = {f"n{i:03d}": i % 5 for i in range(60)}
    pairs = [(a, b, 1) for a, b in itertools.combinations(sorted(group), 2) if rng.random() < (0.6 if group[a] == group[b] else 0.03)]
    return group, pairs + [("hub", n, 1) for n in group if group[n] == 2]


def test_few_tables_and_hubs(spark, monkeypatch):
    group, pairs = planted()
    monkeypatch.setattr(louvain_arrays, "BLOCK_LINKS", 3)
    monkeypatch.setattr(louvain_arrays, "HUB_LINKS", 7)
    written = []
    for module in (by, louvain_arrays):
        write = module.stage
        monkeypatch.setattr(module, "stage", lambda df, write=write: written.append(1) or write(df))
    label = found(by.louvain(graph(spark, pairs), refinements=1))
    assert modularity(pairs, label) >= modularity(pairs, {**group, "hub": 2}) - 1e-9
    assert label["hub"] == "hub" and len(set(label.values())) == 5  # the smallest member of its community
    assert len(written) <= 16  # no table for a sweep


@pytest.mark.parametrize("block,hub", [(3, 7), (256, 4096)])
def test_blocks_hold_every_link(spark, monkeypatch, block, hub):
    monkeypatch.setattr(louvain_arrays, "BLOCK_LINKS", block)
    monkeypatch.setattr(louvain_arrays, "HUB_LINKS", hub)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rng = random.Random(1)
        links = sorted({(a, b) for a in range(30) for b in rng.sample(range(30), 1 + a % 29)})
        made = louvain_arrays.links(spark.createDataFrame([(a, b, 1.0 + a) for a, b in links], "a int, b int, w double"), 31)
        rows = made.blocks.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(x for r in rows for x in zip(r["a"], r["b"])) == links
    assert all(len(set(r["a"])) == 1 for r in rows if r["hub"])
    whole = [a for r in rows if not r["hub"] for a in set(r["a"])]
    assert len(whole) == len(set(whole)) and not set(whole) & {a for r in rows if r["hub"] for a in r["a"]}
    assert made.degrees.tolist() == [sum(1.0 + a for x, _ in links if x == a) for a in range(31)]


def test_larger_graphs_go_by_joins(spark):
    group, pairs = planted()
    label = found(by.louvain(graph(spark, pairs), refinements=0, array_nodes=0))
    assert modularity(pairs, label) >= 0.95 * modularity(pairs, {**group, "hub": 2})
