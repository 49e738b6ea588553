"""Communities by modularity: local moves in parallel, then contraction, level by level.

Modularity of a labelling with resolution r: the sum over communities of inside / total - r * (degree / total)^2,
all weights counted from both ends of an edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators import louvain_arrays as arrays
from palimpsest.operators.community import both_ways, once
from palimpsest.operators.skew import split_hot_join
from palimpsest.session import stage

#: A sweep that gains less modularity than this is the last of its level.
LEAST_GAIN = 1e-6
SWEEPS, LEVELS, REFINEMENTS = 16, 12, 2
#: Nodes whose labels may go to every task as arrays (13 bytes a node).
ARRAY_NODES = 16_000_000


def weighted_adjacency(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``a, b, w`` in both directions: each linked pair once with weight 1, or with the sum of a column over its edges."""
    if weight is None:
        return both_ways(edges).withColumn("w", F.lit(1.0))
    e = edges.filter(F.col("source_uuid") != F.col("target_uuid")).select(
        F.least("source_uuid", "target_uuid").alias("a"), F.greatest("source_uuid", "target_uuid").alias("b"), F.col(weight).cast("double").alias("w"))
    one = e.groupBy("a", "b").agg(F.sum("w").alias("w"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def quality(adj: DataFrame, labels: DataFrame, total: float, resolution: float = 1.0) -> float:
    """Modularity of ``uuid, label`` over ``a, b, w`` (a community's own weight stands on its diagonal)."""
    per = _labelled(adj, labels).groupBy("la").agg(
        F.sum("w").alias("degree"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inside"))
    return per.agg(F.coalesce(F.sum(F.col("inside") / total - resolution * F.pow(F.col("degree") / total, F.lit(2.0))), F.lit(0.0))).first()[0]


def _labelled(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """Both ends' labels.  Labels are unique by node, so adaptive execution may split a hub's rows."""
    la, lb = (labels.select(F.col("uuid").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    return adj.join(la, "a").join(lb, "b")


def _moves(adj: DataFrame, state: DataFrame, total: float, resolution: float, active: Column) -> DataFrame:
    """New ``uuid, k, label``: each active node goes to the neighbouring community that gains most, if any gains; ties to the smallest label.

    Two nodes that are each alone could swap for ever: of these only the larger moves to the smaller.
    """
    sums = state.groupBy("label").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
    at = state.filter(active).select(F.col("uuid").alias("a"), "k", F.col("label").alias("own"))
    near = adj.filter("a <> b").join(at.select("a"), "a", "left_semi").join(state.select(F.col("uuid").alias("b"), "label"), "b")
    own = at.select("a", F.col("own").alias("label"), F.lit(0.0).alias("w"))  # a node may have no neighbour in its community
    options = near.select("a", "label", "w").unionByName(own).groupBy("a", "label").agg(F.sum("w").alias("w"))
    options = options.join(at, "a").join(sums, "label")
    stays = F.col("label") == F.col("own")
    rest = F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - resolution * F.col("k") * rest / total, 9)
    order = F.struct((-F.col("gain")).alias("g"), (~F.col("stays")).alias("s"), "label")  # a move must gain
    scored = options.select("a", "label", "own", gain.alias("gain"), "members", stays.alias("stays"))
    # the best of all, and the best without moves of a lonely node to a lonely node of larger label
    free = F.col("stays") | (F.col("members") > 1) | (F.col("label") < F.col("own"))
    picked = scored.groupBy(F.col("a").alias("uuid")).agg(
        F.min(order)["label"].alias("any"), F.min(F.when(free, order))["label"].alias("safe"), F.max(F.col("stays") & (F.col("members") == 1)).alias("alone"))
    moved = picked.select("uuid", F.when(F.col("alone"), F.col("safe")).otherwise(F.col("any")).alias("new"))
    return state.join(moved, "uuid", "left").select("uuid", "k", F.coalesce("new", "label").alias("label"))


def _level(adj: DataFrame, total: float, resolution: float, sweeps: int, start_at: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Labels of one level's nodes (the best seen) and whether they are better than the first ones: all apart, or ``start_at``.

    A sweep lets about half of the nodes move, the other half in the next, so that neighbours seldom move past each other.
    """
    state = adj.groupBy(F.col("a").alias("uuid")).agg(F.sum("w").alias("k"))
    state = stage(state.withColumn("label", F.col("uuid")) if start_at is None else state.join(start_at, "uuid"))
    best, score = state, quality(adj, state, total, resolution)
    start, flat = score, 0
    for sweep in range(sweeps):
        active = F.pmod(F.xxhash64("uuid", F.lit(sweep // 2)), F.lit(2)) == sweep % 2
        state = stage(_moves(adj, state, total, resolution, active))
        now = quality(adj, state, total, resolution)
        flat = 0 if now > score + LEAST_GAIN else flat + 1
        if now > score:
            best, score = state, now
        if flat == 2:  # neither half gained
            break
    return best.select("uuid", "label"), score > start + LEAST_GAIN


def _contracted(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of communities."""
    return stage(_labelled(adj, labels).groupBy("la", "lb").agg(F.sum("w").alias("w")).select(F.col("la").alias("a"), F.col("lb").alias("b"), "w"))


def _through(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of labels."""
    return stage(found.withColumnRenamed("label", "via").join(labels.withColumnRenamed("uuid", "via"), "via").select("uuid", "label"))


def _numbered(edges: DataFrame, weight: str | None) -> tuple[DataFrame, DataFrame, int]:
    """Nodes ``uuid, id`` (from 0, in order of ``uuid``), both directions ``a, b, w`` of their numbers, and how many nodes there are."""
    if weight is None:
        pairs = once(edges).withColumn("w", F.lit(1.0))
    else:
        pairs = weighted_adjacency(edges, weight).filter("a < b")
    pairs = stage(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("uuid")).distinct().orderBy("uuid")
    nodes = stage(nodes.withColumn("at", F.monotonically_increasing_id()))
    # the upper bits of such an id are its partition, the lower ones count from 0
    part = F.shiftright("at", 33)
    starts, n = [], 0
    for p, rows in sorted(nodes.groupBy(part.alias("part")).count().collect()):
        starts.append((p, n - (p << 33)))
        n += rows
    shift = edges.sparkSession.createDataFrame(starts, "part long, shift long")
    nodes = stage(nodes.withColumn("part", part).join(F.broadcast(shift), "part").select("uuid", (F.col("at") + F.col("shift")).alias("id")))
    a, b = (nodes.select(F.col("uuid").alias(x), F.col("id").alias(f"i{x}")) for x in "ab")
    ends = pairs.join(a, "a").select("ia", "b", "w").join(b, "b").select("ia", "ib", "w")
    both = F.explode(F.array(F.struct(F.col("ia").alias("a"), F.col("ib").alias("b"), "w"), F.struct(F.col("ib").alias("a"), F.col("ia").alias("b"), "w"))).alias("e")
    return nodes, ends.select(both).select("e.*"), n


def louvain(edges: DataFrame, *, resolution: float = 1.0, min_community_size: int = 1, weight: str | None = None,
            sweeps: int = SWEEPS, levels: int = LEVELS, refinements: int = REFINEMENTS, array_nodes: int = ARRAY_NODES) -> DataFrame:
    """``uuid, community`` (its smallest member) of every node in a community of at least ``min_community_size``.

    A higher resolution gives smaller communities.  Up to ``array_nodes`` nodes, a level's labels go to every task as arrays and
    a sweep is one pass over the links without a shuffle; the links are never on the driver.  In a larger graph labels and links
    meet by joins, and one number for each sweep comes to the driver.  When no level gains, single nodes may move
    once more from where they are, and if that gains, communities are contracted again.
    """
    nodes, adj, n = _numbered(edges, weight)
    by = _by_arrays if n <= array_nodes else _by_joins
    found = by(nodes, adj, n, resolution, sweeps, levels, refinements)
    sizes = found.groupBy("label").agg(F.min("uuid").alias("community"), F.count("*").alias("n")).filter(F.col("n") >= min_community_size)
    return split_hot_join(found, sizes.select("label", "community"), ["label"]).select("uuid", "community")


def _by_arrays(nodes: DataFrame, adj: DataFrame, n: int, resolution: float, sweeps: int, levels: int, refinements: int) -> DataFrame:
    """``uuid, label``."""
    whole = arrays.links(adj, n)
    total = float(whole.degrees.sum())
    found = np.arange(n, dtype=np.int32)
    labels, better = arrays.level(whole, total, resolution, sweeps, LEAST_GAIN) if total else (found, False)
    for _ in range(refinements + 1):
        if not better:
            break
        found, graph = labels, whole
        for _ in range(levels):
            graph = arrays.contracted(graph, labels)
            labels, better = arrays.level(graph, total, resolution, sweeps, LEAST_GAIN)
            if not better:
                break
            found = labels[found]
        labels, better = arrays.level(whole, total, resolution, sweeps, LEAST_GAIN, found)
    if better:
        found = labels
    sent = nodes.sparkSession.sparkContext.broadcast(found)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value[batch.column(1).to_numpy()])], ["uuid", "label"])

    return stage(nodes.select("uuid", "id").mapInArrow(named, f"uuid {dict(nodes.dtypes)['uuid']}, label int"))


def _by_joins(nodes: DataFrame, adj: DataFrame, n: int, resolution: float, sweeps: int, levels: int, refinements: int) -> DataFrame:
    """``uuid, label``: every level writes its labels and the contracted graph, which shrinks from level to level."""
    whole = stage(adj)
    total = whole.agg(F.sum("w")).first()[0]
    found = nodes.select(F.col("id").alias("uuid"), F.col("id").alias("label"))
    labels, better = _level(whole, total, resolution, sweeps) if total else (found, False)
    for _ in range(refinements + 1):
        if not better:
            break
        found, adj = stage(labels), whole
        for _ in range(levels):
            adj = _contracted(adj, labels)
            labels, better = _level(adj, total, resolution, sweeps)
            if not better:
                break
            found = _through(found, labels)
        labels, better = _level(whole, total, resolution, sweeps, found)
    if better:
        found = stage(labels)
    return nodes.join(found.withColumnRenamed("uuid", "id"), "id").select("uuid", "label")
