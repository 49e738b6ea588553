"""Louvain's local moves where the labels of all nodes go to every task as arrays: a pass over the links is a sweep, and nothing is shuffled.

A graph has nodes ``0 .. n - 1``.  Its links lie in blocks, rows of whole nodes; the links of a hub fill several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.session import stage

#: Links from which a block is closed, and links of one node beyond which it is a hub.
BLOCK_LINKS, HUB_LINKS = 256, 4096
_BLOCK = "hub boolean, a array<int>, b array<int>, w array<double>"


@dataclass(frozen=True)
class Links:
    """Links in both directions, a loop once."""

    blocks: DataFrame  # hub, a, b, w
    hubs: bool
    degrees: np.ndarray


def links(adj: DataFrame, n: int) -> Links:
    """Blocks of ``a, b, w`` (whole numbers below ``n``, each pair once)."""
    block, hub = BLOCK_LINKS, HUB_LINKS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, inside = None, False  # what waits, and whether its first node is a hub that has begun
        for batch in _and_end(_columns(batches)):
            if batch is not None:
                rest = batch if rest is None else tuple(np.concatenate(x) for x in zip(rest, batch))
            if rest is None:
                return
            a = rest[0]
            starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            ends = np.append(starts[1:], len(a))
            if batch is not None:  # the last node may go on
                starts, ends = starts[:-1], ends[:-1]
            bounds, kinds, at = [0], [], 0
            for first, last in zip(starts.tolist(), ends.tolist()):
                if last - first > hub or (inside and first == 0):
                    if first > at:
                        bounds.append(first)
                        kinds.append(False)
                    bounds += [*range(first + hub, last, hub), last]
                    kinds += [True] * (len(bounds) - 1 - len(kinds))
                    at = last
                elif last - at >= block:
                    bounds.append(last)
                    kinds.append(False)
                    at = last
            done = int(ends[-1]) if len(ends) else 0
            if done > at:
                bounds.append(done)
                kinds.append(False)
            if done:
                inside = False
            if batch is not None and len(a) - done > hub:  # a hub that goes on: what is there can go
                bounds.append(len(a))
                kinds.append(True)
                inside, done = True, len(a)
            if kinds:
                yield _block_rows(kinds, bounds, [x[:done] for x in rest])
            rest = tuple(x[done:] for x in rest) if done < len(a) else None

    placed = adj.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("w").cast("double").alias("w"))
    blocks = stage(placed.repartition("a").sortWithinPartitions("a", "b").mapInArrow(cut, _BLOCK))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, _, w in _flat(batches):
            nodes, of = np.unique(a, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.bincount(of, w))], ["u", "k"])

    sums = blocks.mapInArrow(weigh, "u int, k double")
    found = sums.groupBy("u").agg(F.sum("k").alias("k")).toArrow()
    degrees = np.zeros(n)
    degrees[found.column("u").to_numpy()] = found.column("k").to_numpy()
    return Links(blocks, not blocks.filter("hub").isEmpty(), degrees)


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    return (tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns) for batch in batches if batch.num_rows)


def _and_end(items: Iterator) -> Iterator:
    yield from items
    yield None


def _block_rows(kinds: list[bool], bounds: list[int], columns: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.array(bounds, np.int32))
    return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in columns)], ["hub", "a", "b", "w"])


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, w of the blocks of a batch."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "b", "w"))


def _summed(first: np.ndarray, second: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``w`` by pairs, in their order."""
    pairs, of = np.unique((first.astype(np.int64) << 32) | second, return_inverse=True)
    return (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), np.bincount(of, w, len(pairs))


def _in_turn(u: np.ndarray, sweep: int) -> np.ndarray:
    """About half of the nodes; the other half in the next sweep."""
    x = u.astype(np.uint64) + np.uint64((sweep // 2 + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(32)) & np.uint64(1)) == np.uint64(sweep % 2)


def _choose(u: np.ndarray, label: np.ndarray, w: np.ndarray, nodes: np.ndarray, k: np.ndarray, state: tuple, total: float, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """``u, label`` of nodes that go elsewhere.

    Each goes to the neighbouring community that gains most, if any gains; ties to the smallest label.  Two nodes that
    are each alone could swap for ever: of these only the larger moves to the smaller.
    """
    labels, weight, alone = state
    u, label, w = _summed(np.concatenate([u, nodes]), np.concatenate([label, labels[nodes]]), np.concatenate([w, np.zeros(len(nodes))]))
    at = np.searchsorted(nodes, u)
    own = labels[u]
    stays = label == own
    gain = np.round(w - resolution * k[at] * (weight[label] - np.where(stays, k[at], 0.0)) / total, 9)
    free = stays | ~alone[label] | (label < own) | ~alone[own]
    u, label, stays, gain = u[free], label[free], stays[free], gain[free]
    order = np.lexsort((label, ~stays, -gain, u))
    best = order[np.append(True, u[order][1:] != u[order][:-1])] if len(order) else order
    best = best[~stays[best]]
    return u[best], label[best]


def _sweep(graph: Links, labels: np.ndarray, weight: np.ndarray, alone: np.ndarray, total: float, resolution: float, sweep: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The weight inside communities, and the nodes that move in this sweep, with their new labels."""
    spark = graph.blocks.sparkSession
    sent = spark.sparkContext.broadcast((labels, weight, alone))
    schema, names = "u int, label int, w double", ["u", "label", "w"]

    def rows(inside: float, moves: tuple) -> pa.RecordBatch:
        """``inside`` stands beside the node -1."""
        u, label = moves
        columns = np.append(u, -1).astype(np.int32), np.append(label, -1).astype(np.int32), np.append(np.zeros(len(u)), inside)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = sent.value
        for a, b, w in _flat(batches):
            near = state[0][b]
            inside = w[near == state[0][a]].sum()
            turn = _in_turn(a, sweep)
            a, b, w, near = a[turn], b[turn], w[turn], near[turn]
            nodes, of = np.unique(a, return_inverse=True)
            k, apart = np.bincount(of, w, len(nodes)), a != b
            yield rows(inside, _choose(a[apart], near[apart], w[apart], nodes, k, state, total, resolution))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a hub's block by label; a loop counts beside the label -1."""
        for a, b, w in _flat(batches):
            label = np.where(a == b, 2**32 - 1, sent.value[0][b].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(a, label, w)], names)

    def hub(table: pa.Table) -> pa.Table:
        u, label, w = (table.column(c).to_numpy() for c in names)
        state, nodes = sent.value, u[:1]
        apart = label >= 0
        inside = w[~apart | (label == state[0][nodes[0]])].sum()
        keep = apart if _in_turn(nodes, sweep)[0] else np.zeros(len(u), bool)
        nodes = nodes if keep.any() else nodes[:0]
        return pa.Table.from_batches([rows(inside, _choose(u[keep], label[keep], w[keep], nodes, np.full(len(nodes), w.sum()), state, total, resolution))])

    found = graph.blocks.filter("NOT hub").mapInArrow(whole, schema)
    if graph.hubs:
        summed = graph.blocks.filter("hub").mapInArrow(parts, schema).groupBy("u", "label").agg(F.sum("w").alias("w"))
        found = found.unionByName(summed.groupBy("u").applyInArrow(hub, schema))
    table = found.toArrow()
    sent.destroy()
    u, label, w = (table.column(c).to_numpy() for c in names)
    return w[u < 0].sum(), u[u >= 0], label[u >= 0]


def level(graph: Links, total: float, resolution: float, sweeps: int, least_gain: float, start_at: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """The best labels seen, as numbers from 0, and whether they are better than the first ones: all apart, or ``start_at``."""
    n = len(graph.degrees)
    labels = np.arange(n, dtype=np.int32) if start_at is None else start_at.astype(np.int32)
    best, score, first, flat = labels, -np.inf, None, 0
    for sweep in range(sweeps + 1):
        weight = np.bincount(labels, graph.degrees, n)
        alone = np.bincount(labels, minlength=n) == 1
        inside, u, label = _sweep(graph, labels, weight, alone, total, resolution, sweep)
        now = inside / total - resolution * float(np.square(weight / total).sum())
        if first is None:
            first = now
        else:
            flat = 0 if now > score + least_gain else flat + 1
        if now > score:
            best, score = labels, now
        if flat == 2:  # neither half gained
            break
        labels = labels.copy()
        labels[u] = label
    return np.unique(best, return_inverse=True)[1].astype(np.int32), score > first + least_gain


def contracted(graph: Links, labels: np.ndarray) -> Links:
    """The graph of communities (``labels`` count from 0), in which a community's inner weight is a loop."""
    sent = graph.blocks.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, w in _flat(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(sent.value[a], sent.value[b], w)], ["a", "b", "w"])

    return links(graph.blocks.mapInArrow(run, "a int, b int, w double").groupBy("a", "b").agg(F.sum("w").alias("w")), int(labels.max()) + 1)
