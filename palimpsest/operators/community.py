"""Communities: components, label propagation (not Louvain) and modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.session import stage


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct undirected adjacency ``a, b`` in both directions, without self-loops."""
    e = edges.filter(F.col("source_uuid") != F.col("target_uuid"))
    ends = F.explode(F.array(F.struct(F.col("source_uuid").alias("a"), F.col("target_uuid").alias("b")),
                             F.struct(F.col("target_uuid").alias("a"), F.col("source_uuid").alias("b"))))
    return e.select(ends.alias("e")).select("e.*").distinct()


def once(edges: DataFrame) -> DataFrame:
    """Distinct undirected pairs ``a < b``, without self-loops."""
    e = edges.filter(F.col("source_uuid") != F.col("target_uuid"))
    return e.select(F.least("source_uuid", "target_uuid").alias("a"), F.greatest("source_uuid", "target_uuid").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``uuid, component`` (the smallest id of the component).

    Each round sends every node to its smallest neighbour and on until one has no smaller, and draws edges
    between these. They are at most half of the nodes, so rounds are few, and no later one reads the first edges again.
    """
    left, rounds = stage(once(edges)), []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("uuid"), F.col("a").alias("m")), F.struct(F.col("b").alias("uuid"), F.col("a").alias("m")))).alias("e"))
        near = stage(ends.select("e.*").groupBy("uuid").agg(F.min("m").alias("m")))
        moved = True
        while moved:  # all go to a node without a smaller neighbour
            far = near.select(F.col("uuid").alias("m"), F.col("m").alias("far"))
            jumped = stage(near.join(far, "m").select("uuid", F.col("far").alias("m"), (F.col("far") != F.col("m")).alias("moved")))
            near, moved = jumped.drop("moved"), not jumped.filter("moved").isEmpty()
        near = near.withColumnRenamed("m", "component")
        rounds.append(near)
        a, b = (near.select(F.col("uuid").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        pairs = left.join(a, "a").select("b", "ca").distinct().join(b, "b").select(F.col("ca").alias("source_uuid"), F.col("cb").alias("target_uuid"))
        left = stage(once(pairs))
    if not rounds:
        return left.select(F.col("a").alias("uuid"), F.col("b").alias("component"))
    labels = rounds.pop()
    while rounds:
        then = labels.select(F.col("uuid").alias("component"), F.col("component").alias("then"))
        labels = stage(rounds.pop().join(then, "component", "left").select("uuid", F.coalesce("then", "component").alias("component")))
    return labels


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """``uuid, label`` after ``rounds`` synchronous rounds; the most frequent neighbour label wins,
    ties go to the smallest."""
    adj = stage(both_ways(edges))
    if not rounds:
        return adj.select(F.col("a").alias("uuid")).distinct().withColumn("label", F.col("uuid"))
    # in the first round every neighbour has one vote, its own id
    labels = stage(adj.groupBy(F.col("a").alias("uuid")).agg(F.min("b").alias("label")))
    for _ in range(rounds - 1):
        votes = adj.join(labels.withColumnRenamed("uuid", "b"), "b").groupBy(F.col("a").alias("uuid"), "label").agg(
            F.count("*").alias("n"))
        labels = stage(votes.groupBy("uuid").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label")))
    return labels


def modularity_score(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``communities, modularity`` of a labelling ``uuid, label`` on the distinct undirected graph.

    Degrees are counted by node; each pair then meets the labels once, in one direction.
    """
    pairs, labels = stage(once(edges)), stage(labels)
    a, b = (labels.select(F.col("uuid").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("uuid")).groupBy("uuid").agg(F.count("*").alias("degree"))
    degrees = ends.join(labels, "uuid").groupBy("label").agg(F.sum("degree").alias("degree"))
    inside = pairs.join(a, "a").join(b, "b").filter("la = lb").groupBy(F.col("la").alias("label")).agg((2 * F.count("*")).alias("inside"))
    two_m = 2.0 * pairs.count()
    per = degrees.join(inside, "label", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    return per.agg(F.count("*").alias("communities"), F.sum(
        F.col("inside") / two_m - F.pow(F.col("degree") / two_m, F.lit(2.0))).alias("modularity"))


def community_table(labels: DataFrame, min_size: int = 1) -> DataFrame:
    """``community_id, member_count``; members stay rows of the labelling, not a list in one row."""
    sizes = labels.groupBy(F.col("label").alias("community_id")).agg(F.count("*").alias("member_count"))
    return sizes.filter(F.col("member_count") >= min_size)
